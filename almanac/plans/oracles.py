"""DuckDB SQL for each query, over the base tables."""

from __future__ import annotations

from almanac.plans.queries import FILTERS, ITEM, KNOWN_ON, LEAST_SCORE, MISSING_ITEM, REGIONS, SHORT, SINCE, UNTIL, USER
from almanac.sources.schemas import DIMENSIONS, OWN_SCORES_LABEL, SCORE_MODE_LABELS, SHELF_LABELS, STATUS_LABELS, WISHLIST_LABEL
from almanac.sources.tables import SNAPSHOT

_SCORE = "CAST(1 + CAST({} % 95 AS INTEGER) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(3,1))"


def _case(column: str, labels: dict[str, str]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


_CATALOG = f"""
lines AS (SELECT l_orderkey AS k, min(p_name) AS title, max(p_name) AS original_title, min(p_brand) AS publisher,
  list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS platforms, list_sort(list(DISTINCT p_type)) AS genres,
  {_SCORE.format('CAST(sum(l_quantity) AS BIGINT)')} AS gameplay, {_SCORE.format('sum(CAST(round(l_extendedprice) AS BIGINT))')} AS story,
  {_SCORE.format('sum(CAST(round(l_discount * 100) AS BIGINT))')} AS visuals, {_SCORE.format('sum(CAST(round(l_tax * 100) AS BIGINT))')} AS music
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
base AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS release_date FROM orders),
dated AS (SELECT *, CASE WHEN release_date IS NULL THEN 'development' WHEN release_date <= DATE '{SNAPSHOT}' THEN 'released' ELSE 'upcoming' END AS status FROM base),
catalog AS (SELECT o_orderkey AS item_id, o_orderkey AS ordinal, title, original_title, c_name AS developer, publisher, n_name AS country, r_name AS region, status, release_date,
  coalesce(strftime(release_date, '%Y.%m.%d'), 'TBA') AS date_label, o_orderpriority = '1-URGENT' AS featured, CASE WHEN o_orderpriority = '5-LOW' THEN 'interview' ELSE 'official' END AS signal,
  CASE WHEN status = 'released' THEN 'initial' ELSE 'expected' END AS score_mode, c_mktsegment || ' ' || o_orderpriority AS summary, c_mktsegment AS fit, o_orderpriority AS caution,
  coalesce(platforms, []) AS platforms, coalesce(genres, []) AS genres, gameplay, story, visuals, music,
  (gameplay + story + visuals + music) * CAST(0.25 AS DECIMAL(3,2)) AS mean,
  r_name AS source_label, url AS source_url, DATE '{SNAPSHOT}' - CAST(o_orderkey % 2 AS INTEGER) AS checked_at, o_orderpriority || ' ' || c_mktsegment AS evidence,
  CASE o_orderstatus WHEN 'F' THEN 'released' WHEN 'O' THEN 'upcoming' ELSE 'development' END AS declared_status,
  CASE WHEN o_orderkey % 97 = 0 OR (o_orderstatus = 'P' AND o_orderkey % 10 <> 0) THEN NULL ELSE CAST(o_orderdate AS DATE) END AS declared_date
  FROM dated JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN lines ON k = o_orderkey
  LEFT JOIN pages ON page_id = o_orderkey % (SELECT count(*) FROM pages))"""

_EVENTS = """
e AS (SELECT event_id AS seq, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v, props FROM events)"""

_STATE = f"""{_EVENTS},
log AS (SELECT *, CASE WHEN k % 10 = 9 THEN -1 ELSE k % 10 END AS item_id FROM e),
wishlist AS (SELECT user_id, item_id, max(seq) AS seq FROM log WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) % 2 = 1),
shelf AS (SELECT user_id, item_id, s AS shelf_status FROM (SELECT user_id, item_id, CASE v % 5 WHEN 0 THEN 'interested' WHEN 1 THEN 'playing' WHEN 2 THEN 'finished' WHEN 3 THEN 'paused' END AS s,
  row_number() OVER (PARTITION BY user_id, item_id ORDER BY seq DESC) AS n FROM log WHERE event_type = 'view') WHERE n = 1 AND s IS NOT NULL),
notes AS (SELECT user_id, item_id, note FROM (SELECT user_id, item_id, CASE WHEN v % 3 = 0 THEN '' ELSE left(props, 500) END AS note,
  row_number() OVER (PARTITION BY user_id, item_id ORDER BY seq DESC) AS n FROM log WHERE event_type = 'signup') WHERE n = 1),
rates AS (SELECT *, max(CASE WHEN v % 5 = 4 THEN seq ELSE -1 END) OVER (PARTITION BY user_id, item_id) AS reset, CAST(1 + CAST(v % 91 AS INTEGER) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(3,1)) AS score FROM log WHERE event_type = 'purchase'),
own AS (SELECT user_id, item_id, {', '.join(f"arg_max(score, seq) FILTER (WHERE v % 4 = {i}) AS {d}" for i, d in enumerate(DIMENSIONS))} FROM rates WHERE seq > reset GROUP BY 1, 2),
ratings AS (SELECT own.user_id, own.item_id, {', '.join(f'coalesce(own.{d}, catalog.{d}) AS {d}' for d in DIMENSIONS)} FROM own LEFT JOIN catalog USING (item_id)),
ids AS (SELECT user_id, item_id FROM wishlist UNION SELECT user_id, item_id FROM shelf)"""

_FEED = f"""{_EVENTS},
feed AS (SELECT seq, user_id * 100 + k AS item_id, CAST(ts AS DATE) AS published_on, {_case('event_type', {'signup': 'announcement', 'click': 'date_change', 'view': 'interview', 'purchase': 'event_preview', 'error': 'rumour'})} AS kind,
  CAST(o_orderdate AS DATE) + CAST(v AS INTEGER) AS new_date FROM e LEFT JOIN orders ON o_orderkey = user_id * 100 + k),
official AS (SELECT * FROM feed WHERE kind IN ('announcement', 'date_change', 'interview')),
current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS n FROM official) WHERE n = 1)"""

_DOUBLES = ", ".join(f"CAST({d} AS DOUBLE) AS {d}" for d in DIMENSIONS)
_MEAN = "CAST(mean AS DOUBLE) AS mean"
_DATE = "CAST(release_date AS VARCHAR) AS release_date"
_BRIEF = f"item_id, title, developer, region, status, {_DATE}"
_STATUS = _case("status", STATUS_LABELS) + " AS status_label"
_PLATFORMS = "array_to_string(list_transform(platforms, lambda p: substr(p, 1, 1) || '-' || substr(p, 2, 1)), ' · ') AS platform_labels"
_DAYS = "date_diff('day', CAST(TIMESTAMP '1998-04-15 03:00:00' + INTERVAL 8 HOUR AS DATE), release_date)"
_COUNTDOWN = f"CASE WHEN status = 'development' OR release_date IS NULL THEN 'TBA' WHEN {_DAYS} < 0 THEN 'OUT NOW' WHEN {_DAYS} = 0 THEN 'TODAY' ELSE 'D-' || {_DAYS} END AS countdown"
_FOUND = lambda q: f"(contains(lower(title), '{q}') OR contains(lower(original_title), '{q}') OR contains(lower(developer), '{q}') OR contains(lower(publisher), '{q}') OR contains(lower(country), '{q}') OR len(list_filter(genres, lambda g: contains(lower(g), '{q}'))) > 0)"
_RADAR = f"status = 'released' AND list_contains(platforms, 'RF') AND region = 'ASIA' AND {_FOUND('ring')}"


def _with(parts: str, body: str) -> str:
    return f"WITH {parts.strip()}\n{body}"


def _on_catalog(body: str) -> str:
    return _with(_CATALOG, body)


def _on_state(body: str) -> str:
    return _with(f"{_CATALOG.strip()},{_STATE}", body)


def _on_feed(body: str) -> str:
    return _with(_FEED, body)


def _top(order: str) -> str:
    return _on_catalog(f"SELECT row_number() OVER (ORDER BY {order}, ordinal) AS rank, item_id, title, {_DATE}, featured, {_MEAN} FROM (SELECT * FROM catalog ORDER BY {order}, ordinal LIMIT 20)")


_OWN = lambda left: f"{', '.join(f'CAST(CASE WHEN ratings.item_id IS NULL THEN {left}.{d} ELSE ratings.{d} END AS DECIMAL(3,1)) AS {d}' for d in DIMENSIONS)}, CASE WHEN ratings.item_id IS NULL THEN {_case(f'{left}.score_mode', SCORE_MODE_LABELS)} ELSE '{OWN_SCORES_LABEL}' END AS mode_label"
_SUM = "CAST((gameplay + story + visuals + music) * CAST(0.25 AS DECIMAL(3,2)) AS DOUBLE)"

# (rule, entity, rows it looks at, what must hold, what a violation shows)
_RULES = [
    ("Q2", "item", "true", "trim(title) <> ''", "title"), ("Q3", "item", "true", "starts_with(source_url, 'https://')", "source_url"), ("Q4", "item", "true", f"checked_at = DATE '{SNAPSHOT}'", "checked_at"),
    ("Q5", "item", "true", "length(evidence) >= 18", "evidence"), ("Q6", "item", "true", "len(platforms) > 0", "len(platforms)"), *((f"Q7.{d}", "item", "true", f"{d} BETWEEN 1 AND 10", d) for d in DIMENSIONS),
    ("Q8", "item", "declared_status = 'development'", "declared_date IS NULL", "declared_date"), ("Q9", "item", "declared_status <> 'development'", "declared_date IS NOT NULL", "declared_date"),
    ("Q10", "item", "declared_status = 'released' AND declared_date IS NOT NULL", f"declared_date <= DATE '{SNAPSHOT}'", "declared_date"), ("Q11", "item", "declared_status = 'upcoming' AND declared_date IS NOT NULL", f"declared_date > DATE '{SNAPSHOT}'", "declared_date"),
    ("Q16.status", "item", "true", "declared_status IN ('released', 'upcoming', 'development')", "declared_status"), ("Q16.region", "item", "true", f"region IN {REGIONS}", "region"), ("Q16.signal", "item", "true", "signal IN ('official', 'interview')", "signal"),
    ("Q16.score_mode", "item", "true", "score_mode IN ('initial', 'expected')", "score_mode"), ("Q16.platforms", "item", "true", "len(list_filter(platforms, lambda p: p NOT IN ('AF', 'AO', 'NF', 'NO', 'RF', 'RO'))) = 0", "array_to_string(platforms, ',')"),
    ("Q17", "item", "true", "(declared_status = 'released') = (score_mode = 'initial')", "declared_status || '/' || score_mode"), ("Q18", "item", "release_date IS NOT NULL", "strftime(release_date, '%Y.%m.%d') = date_label", "date_label"),
    ("Q13", "signal", "true", "regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$')", "date"), ("Q14", "signal", "true", "starts_with(source_url, 'https://')", "source_url"), ("Q15", "signal", "true", "length(detail) >= 20", "detail"),
    ("Q16.kind", "signal", "true", "kind IN ('announcement', 'date_change', 'interview', 'event_preview')", "kind"),
]
_QUALITY = f"""{_CATALOG.strip()},{_FEED},
item AS (SELECT *, item_id AS key FROM catalog),
signal AS (SELECT seq AS key, CASE WHEN seq % 11 = 0 THEN strftime(published_on, '%Y.%m.%d') ELSE CAST(published_on AS VARCHAR) END AS date, url AS source_url, concat_ws(' ', kind, CAST(item_id AS VARCHAR)) AS detail, kind
  FROM feed LEFT JOIN pages ON page_id = seq % (SELECT count(*) FROM pages))"""
_IDS = "(SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)"

#: Each user's state as the text of one JSON document; parts and scores that are absent are left out.
_DOCUMENTS = f"""SELECT user_id, '{{' || concat_ws(',', '"wishlist":[' || w.part || ']', '"shelf":{{' || s.part || '}}', '"ratings":{{' || r.part || '}}', '"notes":{{' || n.part || '}}') || '}}' AS doc
FROM (SELECT user_id, string_agg('"' || item_id || '"', ',' ORDER BY seq, item_id) AS part FROM wishlist GROUP BY 1) w
FULL JOIN (SELECT user_id, string_agg('"' || item_id || '":"' || shelf_status || '"', ',' ORDER BY CAST(item_id AS VARCHAR)) AS part FROM shelf GROUP BY 1) s USING (user_id)
FULL JOIN (SELECT user_id, string_agg('"' || item_id || '":{{' || concat_ws(',', {', '.join(f"""'"{d}":' || CAST({d} AS VARCHAR)""" for d in DIMENSIONS)}) || '}}', ',' ORDER BY CAST(item_id AS VARCHAR)) AS part FROM ratings GROUP BY 1) r USING (user_id)
FULL JOIN (SELECT user_id, string_agg('"' || item_id || '":' || CAST(to_json(note) AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS part FROM notes GROUP BY 1) n USING (user_id)"""

_LOOKUP = _on_catalog(" UNION ALL ".join(f"(SELECT CAST({k} AS BIGINT) AS asked, item_id, title FROM catalog ORDER BY item_id = {k} DESC, ordinal LIMIT 1)" for k in (ITEM, MISSING_ITEM)))
_CONDITIONS = {"status": f"status = '{FILTERS['status']}'", "region": f"region = '{FILTERS['region']}'", "platform": f"list_contains(platforms, '{FILTERS['platform']}')"}
#: (facet, its value, the other facets' filters)
_FACETS = [(f, "unnest(platforms)" if f == "platform" else f, " AND ".join(c for g, c in _CONDITIONS.items() if g != f)) for f in ("status", "region", "platform")]

_HISTORY = _on_feed("""SELECT item_id, revision, seq, kind, CAST(old_date AS VARCHAR) AS old_date, CAST(new_date AS VARCHAR) AS new_date, days_moved,
CASE WHEN revision = 1 THEN 'first' WHEN days_moved < 0 THEN 'earlier' WHEN days_moved > 0 THEN 'delayed' WHEN days_moved = 0 THEN 'unchanged' ELSE 'unknown' END AS direction
FROM (SELECT *, date_diff('day', old_date, new_date) AS days_moved FROM (SELECT *, lag(new_date) OVER w AS old_date, row_number() OVER w AS revision FROM official WINDOW w AS (PARTITION BY item_id ORDER BY seq)))""")

ORACLE_SQL: dict[str, str] = {
    "catalog_scan": _on_catalog(f"SELECT item_id, ordinal, title, original_title, developer, publisher, country, region, status, signal, {_DATE}, date_label, array_to_string(platforms, ',') AS platforms, array_to_string(genres, ',') AS genres, {_DOUBLES}, score_mode, featured FROM catalog"),
    "signal_scan": _on_feed("SELECT seq, item_id, CAST(published_on AS VARCHAR) AS published_on, kind, CAST(new_date AS VARCHAR) AS new_date FROM feed"),
    "source_ledger": _on_catalog(f"SELECT item_id, title, developer, evidence, {_STATUS}, CAST(checked_at AS VARCHAR) AS checked_at, source_label, source_url FROM catalog"),
    "card_projection": _on_state(f"""SELECT c.item_id, country, signal, date_label, title, original_title, summary, array_to_string(genres[1:3], ',') AS genres, {_PLATFORMS}, {_DOUBLES.replace('CAST(', 'CAST(c.').replace('c.c.', 'c.')}, {_STATUS}, {_COUNTDOWN}, wished
FROM (SELECT c.* EXCLUDE ({', '.join(DIMENSIONS)}), {_OWN('c')}, w.item_id IS NOT NULL AS wished FROM catalog c LEFT JOIN (SELECT * FROM ratings WHERE user_id = {USER}) ratings ON ratings.item_id = c.item_id LEFT JOIN (SELECT * FROM wishlist WHERE user_id = {USER}) w ON w.item_id = c.item_id) c"""),
    "platform_explode": _on_catalog("SELECT item_id, platform, substr(platform, 1, 1) || '-' || substr(platform, 2, 1) AS platform_label FROM (SELECT item_id, unnest(platforms) AS platform FROM catalog)"),
    "scalar_formats": _on_catalog("""SELECT item_id, strftime(release_date, '%Y.%m.%d') AS dotted, strftime(release_date, '%Y-%m') AS month, strftime(release_date, '%Y') AS year, strftime(release_date, '%m') AS month_number, strftime(release_date, '%d') AS day,
upper(substr(CASE WHEN item_id < 10 THEN '0' || item_id ELSE CAST(item_id AS VARCHAR) END, 1, 2)) || ' / ' || substr(date_label, 1, 4) AS art_index, array_to_string(platforms, ' · ') AS platforms, CAST(CAST(round(mean, 1) AS DECIMAL(6,1)) AS VARCHAR) AS mean_text FROM catalog"""),
    "countdown": _on_catalog(f"SELECT item_id, {_DAYS} AS days, {_COUNTDOWN} FROM catalog"),
    "radar": _on_catalog(f"""SELECT row_number() OVER (ORDER BY featured DESC, release_date DESC NULLS LAST, ordinal) AS rank, item_id, title, developer, region, status, {_DATE}, featured, {_MEAN}
FROM (SELECT * FROM catalog WHERE {_RADAR} ORDER BY featured DESC, release_date DESC NULLS LAST, ordinal LIMIT 20)"""),
    "filter_status": _on_catalog(f"SELECT {_BRIEF} FROM catalog WHERE status = 'upcoming'"),
    "filter_platform": _on_catalog(f"SELECT {_BRIEF} FROM catalog WHERE list_contains(platforms, 'NO')"),
    "filter_region": _on_catalog(f"SELECT {_BRIEF} FROM catalog WHERE region = 'EUROPE'"),
    "search_keyword": _on_catalog(f"SELECT {_BRIEF} FROM catalog WHERE {_FOUND('econ')}"),
    "filter_date_score_range": _on_catalog(f"SELECT {_BRIEF} FROM catalog WHERE release_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' AND mean >= {LEAST_SCORE}"),
    "undated_items": _on_catalog("SELECT item_id, title, status FROM catalog WHERE release_date IS NULL"),
    "lookup_or_first": _LOOKUP,
    "item_dossier": _on_state(f"""SELECT item_id, title, original_title, developer, country, summary, fit, caution, {_DOUBLES}, {_SUM} AS mean, mode_label, note, {_case('shelf_status', SHELF_LABELS)} AS shelf_label, wished, source_label, source_url, CAST(checked_at AS VARCHAR) AS checked_at, evidence
FROM (SELECT c.* EXCLUDE ({', '.join(DIMENSIONS)}), {_OWN('c')}, coalesce(note, '') AS note, shelf_status, w.item_id IS NOT NULL AS wished FROM catalog c
  LEFT JOIN (SELECT * FROM ratings WHERE user_id = {USER}) ratings ON ratings.item_id = c.item_id LEFT JOIN (SELECT * FROM notes WHERE user_id = {USER}) n ON n.item_id = c.item_id
  LEFT JOIN (SELECT * FROM shelf WHERE user_id = {USER}) s ON s.item_id = c.item_id LEFT JOIN (SELECT * FROM wishlist WHERE user_id = {USER}) w ON w.item_id = c.item_id WHERE c.item_id = {ITEM})"""),
    "lookup_stored": _LOOKUP,
    "search_trigrams": _on_catalog(f"SELECT {_BRIEF} FROM catalog WHERE {_FOUND('econ')}"),
    "search_short_keyword": _on_catalog(f"SELECT {_BRIEF} FROM catalog WHERE {_FOUND(SHORT.lower())}"),
    "bitmap_counts": _on_catalog(f"SELECT count(*) FILTER (WHERE {_RADAR}) AS shown, count(*) AS total FROM catalog"),
    "bitmap_facets": _on_catalog(" UNION ALL ".join(f"SELECT '{facet}' AS facet, {kept} AS filtered, coalesce(v, 'all') AS value, n FROM (SELECT v, count(*) AS n FROM (SELECT {value} AS v FROM catalog WHERE {where}) GROUP BY v UNION ALL SELECT NULL, count(*) FROM catalog WHERE {where})"
        for facet, value, others in _FACETS for kept, where in (("false", "true"), ("true", others)))),
    "sort_recommend_topk": _top("featured DESC, release_date DESC NULLS LAST"),
    "sort_date_asc_topk": _top("release_date ASC NULLS LAST"),
    "sort_date_desc_topk": _top("release_date DESC NULLS LAST"),
    "sort_score_topk": _top("mean DESC NULLS LAST"),
    "signal_latest": _on_feed("SELECT '0' || row_number() OVER (ORDER BY published_on DESC, seq DESC) AS display_index, seq, item_id, strftime(published_on, '%Y.%m.%d') AS published, kind FROM (SELECT * FROM feed ORDER BY published_on DESC, seq DESC LIMIT 4)"),
    "score_mean": _on_catalog(f"SELECT item_id, {_MEAN} FROM catalog"),
    "effective_scores": _on_state(f"SELECT user_id, item_id, {_DOUBLES}, {_SUM} AS mean, {', '.join(f'CAST({d} * 10 AS DOUBLE) AS {d}_bar' for d in DIMENSIONS)}, mode_label FROM (SELECT ids.user_id, ids.item_id, {_OWN('catalog')} FROM ids JOIN catalog USING (item_id) LEFT JOIN ratings ON ratings.user_id = ids.user_id AND ratings.item_id = ids.item_id)"),
    "result_counts": _on_catalog(f"SELECT count(*) FILTER (WHERE {_RADAR}) AS shown, count(*) AS total FROM catalog"),
    "facet_status": _on_catalog("SELECT coalesce(status, 'all') AS status, count(*) AS n FROM catalog GROUP BY ROLLUP (catalog.status)"),
    "dated_counts": _on_catalog("SELECT count(release_date) AS dated, count(*) - count(release_date) AS undated FROM catalog"),
    "release_calendar": _on_catalog(f"SELECT strftime(release_date, '%Y-%m') AS release_month, strftime(release_date, '%d') AS day, {_DATE}, ordinal, item_id, title, original_title, {_STATUS}, {_PLATFORMS} FROM catalog WHERE release_date IS NOT NULL"),
    "calendar_month_counts": _on_catalog("SELECT strftime(release_date, '%Y-%m') AS release_month, count(*) AS n FROM catalog WHERE release_date IS NOT NULL GROUP BY 1"),
    "wishlist_current": _on_state("SELECT * FROM wishlist"),
    "shelf_current": _on_state("SELECT * FROM shelf"),
    "ratings_current": _on_state(f"SELECT user_id, item_id, {_DOUBLES} FROM ratings"),
    "notes_current": _on_state("SELECT *, length(note) AS note_length FROM notes"),
    "personal_ids": _on_state("SELECT * FROM ids"),
    "my_shelf": _on_state(f"""SELECT user_id, item_id, shelf_label, title, note_text, {_DOUBLES}, {_SUM} AS mean FROM (SELECT ids.user_id, ids.item_id, coalesce({_case('shelf_status', SHELF_LABELS)}, '{WISHLIST_LABEL}') AS shelf_label, title, coalesce(nullif(note, ''), fit) AS note_text, {_OWN('catalog')}
FROM ids JOIN catalog USING (item_id) LEFT JOIN shelf ON shelf.user_id = ids.user_id AND shelf.item_id = ids.item_id LEFT JOIN notes ON notes.user_id = ids.user_id AND notes.item_id = ids.item_id LEFT JOIN ratings ON ratings.user_id = ids.user_id AND ratings.item_id = ids.item_id)"""),
    "wish_flag": _on_state(f"SELECT c.item_id, w.item_id IS NOT NULL AS wished FROM catalog c LEFT JOIN (SELECT item_id FROM wishlist WHERE user_id = {USER}) w ON w.item_id = c.item_id"),
    "shelf_stats": _on_state("""SELECT user_id, count(*) FILTER (WHERE tag = 'wish') AS wishlist_size, count(*) FILTER (WHERE tag = 'playing') AS playing, count(*) FILTER (WHERE tag = 'finished') AS finished, count(*) FILTER (WHERE tag = 'rating') AS rated FROM (
SELECT user_id, 'wish' AS tag FROM wishlist UNION ALL SELECT user_id, 'rating' FROM ratings UNION ALL SELECT user_id, CASE WHEN item_id IN (SELECT item_id FROM catalog) THEN shelf_status END FROM shelf) GROUP BY user_id"""),
    "state_orphans": _on_state("SELECT kind, user_id, item_id FROM (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, user_id, item_id FROM {t}" for kind, t in (("wishlist", "wishlist"), ("shelf", "shelf"), ("rating", "ratings"), ("note", "notes"))) + ") WHERE item_id NOT IN (SELECT item_id FROM catalog)"),
    "state_encode": _on_state(_DOCUMENTS),
    "state_write": _on_state(_DOCUMENTS),
    "state_quarantine": _on_state(f"SELECT user_id, left(doc, length(doc) - 2) AS doc FROM ({_DOCUMENTS}) WHERE user_id % 7 = 0"),
    "state_decode": _on_state("SELECT user_id, " + ", ".join(f"CASE WHEN user_id % 7 = 0 THEN 0 ELSE count(*) FILTER (WHERE tag = '{t}') END AS n_{t}" for t in ("wishlist", "shelf", "ratings", "notes")) + ", user_id % 7 = 0 AS corrupt FROM (" + " UNION ALL ".join(f"SELECT user_id, '{t}' AS tag FROM {t}" for t in ("wishlist", "shelf", "ratings", "notes")) + ") GROUP BY user_id"),
    "state_explode": _on_state(f"""SELECT * FROM (SELECT user_id, 'wishlist' AS kind, CAST(item_id AS VARCHAR) AS item_id, CAST(NULL AS VARCHAR) AS value FROM wishlist UNION ALL SELECT user_id, 'shelf', CAST(item_id AS VARCHAR), shelf_status FROM shelf
UNION ALL SELECT user_id, 'rating', CAST(item_id AS VARCHAR), {" || '/' || ".join(f"coalesce(CAST({d} AS VARCHAR), '-')" for d in DIMENSIONS)} FROM ratings UNION ALL SELECT user_id, 'note', CAST(item_id AS VARCHAR), note FROM notes) WHERE user_id % 7 <> 0"""),
    "current_release_date": _on_feed("SELECT item_id, CAST(new_date AS VARCHAR) AS new_date, kind, CAST(published_on AS VARCHAR) AS published_on, seq FROM current"),
    "release_date_history": _HISTORY,
    "unverified_claims": _on_feed("SELECT seq, item_id, kind, CAST(published_on AS VARCHAR) AS published_on, CAST(new_date AS VARCHAR) AS new_date FROM feed WHERE kind IN ('event_preview', 'rumour')"),
    "derive_status": _on_feed(f"SELECT o_orderkey AS item_id, CAST(new_date AS VARCHAR) AS official_date, CASE WHEN new_date IS NULL THEN 'development' WHEN new_date <= DATE '{SNAPSHOT}' THEN 'released' ELSE 'upcoming' END AS status FROM orders LEFT JOIN current ON item_id = o_orderkey"),
    "dq_violations": _with(_QUALITY, " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{t}' AS entity, CAST(key AS VARCHAR) AS key, CAST({shown} AS VARCHAR) AS observed FROM {t} WHERE {applies} AND NOT coalesce({ok}, false)" for r, t, applies, ok, shown in _RULES)
        + f" UNION ALL SELECT 'Q1', 'item', CAST(o_orderkey AS VARCHAR), CAST(n AS VARCHAR) FROM {_IDS} WHERE n > 1 UNION ALL SELECT 'Q12', 'signal', '*', CAST(n AS VARCHAR) FROM (SELECT count(*) AS n FROM signal) WHERE n < 4"),
    "dq_summary": _with(_QUALITY, " UNION ALL ".join(f"SELECT '{r}' AS rule_id, count(*) FILTER (WHERE {applies}) AS checked, count(*) FILTER (WHERE {applies} AND NOT coalesce({ok}, false)) AS failed FROM {t}" for r, t, applies, ok, _ in _RULES)
        + f" UNION ALL SELECT 'Q1', count(*), count(*) FILTER (WHERE n > 1) FROM {_IDS} UNION ALL SELECT 'Q12', 1, CASE WHEN count(*) < 4 THEN 1 ELSE 0 END FROM signal"),
    "dq_publish": _with(_QUALITY, "SELECT key AS item_id, broken = '' AS published, broken FROM (SELECT key, concat_ws(',', " + ", ".join(f"CASE WHEN {applies} AND NOT coalesce({ok}, false) THEN '{r}' END" for r, t, applies, ok, _ in _RULES if t == "item") + ") AS broken FROM item)"),
    "dq_publish_summary": _with(_QUALITY, " UNION ALL ".join(f"SELECT '{r}' AS rule_id, count(*) FILTER (WHERE {applies}) AS checked, count(*) FILTER (WHERE {applies} AND NOT coalesce({ok}, false)) AS failed FROM {t}" for r, t, applies, ok, _ in _RULES)),
    "stream_documents": _on_state(_DOCUMENTS),
    "stream_counts": _on_feed(f"""SELECT kind, value, count(*) AS n FROM (SELECT unnest([{{'kind': 'status', 'value': 'all'}}, {{'kind': 'status', 'value': CASE WHEN new_date IS NULL THEN 'development' WHEN new_date <= DATE '{SNAPSHOT}' THEN 'released' ELSE 'upcoming' END}},
{{'kind': 'dated', 'value': CASE WHEN new_date IS NULL THEN 'undated' ELSE 'dated' END}}, {{'kind': 'month', 'value': strftime(new_date, '%Y-%m')}}], recursive := true) FROM orders LEFT JOIN current ON item_id = o_orderkey) WHERE value IS NOT NULL GROUP BY kind, value"""),
    "stream_revisions": _HISTORY,
    "release_date_as_of": _on_feed(f"SELECT item_id, CAST(new_date AS VARCHAR) AS new_date, kind, CAST(published_on AS VARCHAR) AS published_on, seq FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS n FROM official WHERE published_on <= DATE '{KNOWN_ON}') WHERE n = 1"),
    "stream_wishlist": _on_state("SELECT user_id, item_id FROM wishlist"),
    "stream_shelf": _on_state("SELECT * FROM shelf"),
    "stream_release_date": _on_feed("SELECT item_id, CAST(new_date AS VARCHAR) AS new_date, kind, seq FROM current"),
}
