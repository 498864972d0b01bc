"""The same canonical frames as SQL, for the oracle only.

``with_frames(sql)`` puts in front of a statement the CTEs it names, in dependency order.
"""

from __future__ import annotations

import re

from agorascope.schemas import SIGNAL_KINDS, SOURCE_KINDS, STORY_TYPES, ARC_STATUSES, VARIANT_TYPES, TIERS
from agorascope.sources.fixtures import AS_OF, FACT_TYPES, REGISTERS, RELATIONS, SCHEDULED, TOPIC_KEYWORDS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def host(url: str) -> str:
    return f"nullif(regexp_replace(regexp_extract(lower({url}), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '^www[.]', ''), '')"


def tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def slug(name: str) -> str:
    return f"trim(regexp_replace(lower({name}), '[^a-z0-9]+', '-', 'g'), '-')"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


T_AS_OF = f"TIMESTAMP '{AS_OF}'"
ND = "(SELECT max(doc_id) + 1 FROM documents)"
NP = "(SELECT max(page_id) + 1 FROM pages)"
NE = "(SELECT max(event_id) FROM events)"
NC = "(SELECT max(conv_id) + 1 FROM conversations)"
SRC_NUM = "CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER)"


def tier_rows() -> str:
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v).upper())

    return ", ".join("(" + ", ".join(lit(v) for v in t) + ")" for t in TIERS)


FRAMES: dict[str, str] = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, props, "
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events",
    "core0": f"""SELECT *, CASE WHEN kind IN ('arxiv','google_news','exa','webset') THEN 'article'
        ELSE 'discourse' END AS category FROM (SELECT *, {_list(SOURCE_KINDS)}[event_id % 9 + 1] AS kind FROM ev)""",
    "core": f"""SELECT event_id AS id, kind, category,
        CASE WHEN category = 'article' THEN 'article' WHEN event_id % 3 = 0 THEN 'post' ELSE 'comment' END AS content_type,
        CAST(event_id AS STRING) AS external_id, CAST(event_id % 9 + 1 AS INTEGER) AS source_config_id,
        concat('u', CAST(user_id AS STRING)) AS author, ts AS captured_at, props AS source_metadata,
        CASE WHEN category = 'article' THEN concat('Article ', CAST(event_id AS STRING)) END AS title,
        CASE WHEN k % 10 <> 0 THEN (k - 50) / CAST(50 AS DOUBLE) END AS sentiment_score,
        CASE WHEN k % 10 = 0 THEN NULL WHEN k > 60 THEN 'positive' WHEN k < 40 THEN 'negative' ELSE 'neutral' END
          AS sentiment_label,
        {_list(REGISTERS)}[k % 4 + 1] AS emotional_register,
        event_id % {ND} AS doc_id, event_id % {NP} AS page_id FROM core0""",
    "rec": f"""SELECT c.*, p.url, CASE WHEN c.category = 'article' THEN {host('p.url')} END AS publisher,
        d.text AS content_text, d.lang AS language
        FROM core c LEFT JOIN pages p ON p.page_id = c.page_id LEFT JOIN documents d ON d.doc_id = c.doc_id""",
    "items1": """SELECT event_id AS id,
        CASE WHEN event_id % 11 = 0 THEN 'job' WHEN event_id % 11 = 1 THEN 'poll' WHEN event_id % 3 = 0 THEN 'story'
          ELSE 'comment' END AS type,
        CASE WHEN event_id % 17 <> 0 THEN concat('u', CAST(user_id AS STRING)) END AS "by",
        CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS time,
        CASE WHEN event_id % 3 = 0 THEN concat('Item ', CAST(event_id AS STRING)) END AS title, event_type AS text,
        CASE WHEN event_id % 3 = 0 THEN concat('https://www.example.org/item/', CAST(event_id AS STRING)) END AS url,
        CASE WHEN k % 10 <> 0 THEN k END AS score, CASE WHEN event_id % 3 = 0 THEN k % 7 END AS descendants,
        CASE WHEN k % 2 = 0 THEN [event_id + 1, event_id + 2] END AS kids,
        CASE WHEN event_id % 3 <> 0 THEN event_id - 1 END AS parent,
        event_id % 29 = 0 AS deleted, event_id % 23 = 0 AS dead FROM ev""",
    "items": "SELECT *, 0 AS delivery FROM items1 UNION ALL SELECT *, 1 FROM items1 WHERE id % 5 = 0",
    "feed": f"""SELECT event_id AS id, 'new' AS feed, {NE} - event_id AS rank FROM events
        UNION ALL SELECT event_id, 'top', event_id * 7919 % 1000003 FROM events""",
    "emb": """SELECT vec_id AS record_id, 'm64' AS model_name, embedding AS vector FROM embeddings
        UNION ALL SELECT vec_id, 'm32', embedding[1:32] FROM embeddings""",
    "topics": f"""SELECT {SRC_NUM} AS id, source AS name, concat('Topic ', CAST({SRC_NUM} AS STRING)) AS display_name,
        concat('c', CAST({SRC_NUM} % 4 AS STRING)) AS cluster,
        {_list(TOPIC_KEYWORDS)}[{SRC_NUM} * 2 + 1 : {SRC_NUM} * 2 + 2] AS keywords
        FROM (SELECT DISTINCT source FROM documents)""",
    "ta": f"""SELECT c.id AS record_id, {SRC_NUM} AS topic_id, 'keyword' AS method, CAST(NULL AS DOUBLE) AS confidence
        FROM core c JOIN documents d ON d.doc_id = c.doc_id
        UNION ALL SELECT vec_id, label, 'cluster', 0.9 FROM embeddings""",
    "ent0": """SELECT n_nationkey AS id, n_name AS name, 'organization' AS type FROM nation
        UNION ALL SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) + 100, p_brand, 'technology'
          FROM (SELECT DISTINCT p_brand FROM part)
        UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 201 ELSE 202 END,
          concat('Status ', o_orderstatus), 'status' FROM (SELECT DISTINCT o_orderstatus FROM orders)""",
    "ent": "SELECT *, CASE WHEN id % 3 = 1 THEN 'index' WHEN id % 3 = 2 THEN 'noindex' END AS indexability FROM ent0",
    "ment0": """SELECT event_id, CAST(event_id * 7 % 25 AS INTEGER) AS entity_id, 0 AS start_offset FROM ev
        UNION ALL SELECT event_id, CAST(user_id % 25 AS INTEGER), NULL FROM ev
        UNION ALL SELECT event_id, CAST(user_id % 25 AS INTEGER), NULL FROM ev WHERE event_id % 10 = 0
        UNION ALL SELECT event_id, CAST(event_id % 25 + 101 AS INTEGER), 10 FROM ev WHERE event_id % 4 = 0
        UNION ALL SELECT event_id, CAST(event_id % 3 + 200 AS INTEGER), 20 FROM ev WHERE event_id % 50 = 0""",
    "ment": """SELECT m.event_id AS record_id, m.entity_id, m.start_offset, m.start_offset + 8 AS end_offset,
        e.ts AS captured_at, (e.k % 50 + 50) / CAST(100 AS DOUBLE) AS confidence
        FROM ment0 m JOIN ev e ON e.event_id = m.event_id""",
    "sig": f"""SELECT event_id AS id, {_list(SIGNAL_KINDS)}[event_id % 11 + 1] AS kind,
        CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 20 AS INTEGER) END AS topic_id,
        CASE WHEN k < 50 THEN 'low' WHEN k < 80 THEN 'medium' ELSE 'high' END AS severity,
        concat('Signal ', CAST(event_id AS STRING)) AS headline, k / CAST(100 AS DOUBLE) AS score, ts AS detected_at,
        CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(ts AS DATE) AS STRING) END AS dedup_key,
        event_id % 2 = 0 AS acknowledged FROM ev WHERE event_type = 'error'""",
    "sigev": f"""SELECT id AS signal_id, 'record' AS target, id * 13 % ({NE} + 1) AS record_id,
          CAST(NULL AS INTEGER) AS entity_id, CAST(NULL AS INTEGER) AS target_topic_id, CAST(NULL AS STRING) AS story_id,
          CAST(0.5 AS DOUBLE) AS weight FROM sig
        UNION ALL SELECT id, 'entity', NULL, CAST(id % 25 AS INTEGER), NULL, NULL, 0.3 FROM sig WHERE id % 2 = 0
        UNION ALL SELECT id, 'topic', NULL, NULL, CAST(id % 20 AS INTEGER), NULL, 0.1 FROM sig WHERE id % 4 = 0
        UNION ALL SELECT id, 'story', NULL, NULL, NULL, CAST(id % {NC} * 100 AS STRING), 0.1 FROM sig WHERE id % 3 = 0""",
    "turns": """SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations""",
    "st": f"""SELECT CAST(c.conv_id * 100 + c.turn AS STRING) AS id, concat('conv-', CAST(c.conv_id AS STRING)) AS slug,
        {_list(STORY_TYPES)}[c.conv_id % 5 + 1] AS type, CAST(c.conv_id % 20 AS INTEGER) AS topic_id,
        substring(c.text, 1, 60) AS headline, substring(c.text, 1, 200) AS synopsis, c.text AS content,
        {_list(ARC_STATUSES)}[c.turn % 5 + 1] AS arc_status, e.ts AS generated_at,
        CASE WHEN c.conv_id % 20 = 3 THEN TIMESTAMP '{SCHEDULED}'
             WHEN c.conv_id % 4 = 0 THEN e.ts + INTERVAL 1 HOUR END AS publish_at,
        c.turn = c.last_turn AS active,
        CASE WHEN c.conv_id % 5 = 4 THEN concat('NATION_', CAST(c.conv_id % 25 AS STRING)) END AS entity_name,
        CAST(c.turn + 1 AS INTEGER) AS version,
        CASE WHEN c.turn > 0 THEN CAST(c.conv_id * 100 + c.turn - 1 AS STRING) END AS previous_version_id,
        CAST(c.turn % 3 AS INTEGER) AS enrichment_version, CASE WHEN c.turn % 3 > 0 THEN e.ts END AS enriched_at,
        concat('model-', CAST(c.conv_id % 3 AS STRING)) AS generation_model,
        [CAST((c.conv_id * 31 + c.turn * 7 + 1) % ({NE} + 1) AS STRING),
         CAST((c.conv_id * 31 + c.turn * 7 + 2) % ({NE} + 1) AS STRING)] AS source_record_ids, c.conv_id, c.turn
        FROM turns c JOIN ev e ON e.event_id = c.conv_id * 17 % ({NE} - 64) + c.turn""",
    "cit": f"""SELECT CAST(x.conv_id * 100 + x.turn AS STRING) AS story_id, x.marker,
        CASE WHEN x.marker < 3 THEN 'internal' ELSE 'external' END AS citation_type, x.record_id,
        p.url AS external_url, {host('p.url')} AS domain,
        CASE WHEN x.marker < 3 THEN {_list(SOURCE_KINDS)}[x.record_id % 9 + 1] END AS platform,
        {_list(FACT_TYPES)}[(x.conv_id + x.marker) % 5 + 1] AS fact_type,
        (x.conv_id * 7 + x.turn * 3 + x.marker) % 100 / CAST(100 AS DOUBLE) AS credibility_score,
        x.marker = 2 AS inferred, x.marker AS position
        FROM (SELECT conv_id, turn, m AS marker,
                CASE WHEN m < 3 THEN (conv_id * 31 + turn * 7 + m) % ({NE} + 1) END AS record_id,
                CASE WHEN m = 3 THEN (conv_id + turn) % {NP} END AS page_id
              FROM conversations, (VALUES (1), (2), (3)) AS v(m)) x
        LEFT JOIN pages p ON p.page_id = x.page_id""",
    "arcs": """SELECT id, concat('arc-', CAST(id AS STRING)) AS slug, concat('Arc ', CAST(id AS STRING)) AS title,
        id AS topic_id FROM (SELECT DISTINCT CAST(conv_id % 10 AS INTEGER) AS id FROM conversations)""",
    "arcm": """SELECT CAST(conv_id * 100 + turn AS STRING) AS story_id, CAST(conv_id % 10 AS INTEGER) AS arc_id
        FROM conversations""",
    "live": """SELECT conv_id, turn, text, CAST(conv_id * 100 + turn AS STRING) AS story_id FROM turns
        WHERE turn = last_turn""",
    "vars": f"""SELECT story_id, {_list(VARIANT_TYPES)}[(conv_id + d) % 6 + 1] AS variant_type,
        substring(text, 1, 80) AS content FROM live, (VALUES (0), (1)) AS v(d)""",
    "refs": """SELECT story_id, 'entity' AS ref_type, concat('nation-', CAST(conv_id % 30 AS STRING)) AS ref_slug FROM live
        UNION ALL SELECT story_id, 'beat', concat('src', CAST(conv_id % 22 AS STRING)) FROM live
        UNION ALL SELECT story_id, 'story', concat('conv-', CAST(conv_id + 1 AS STRING)) FROM live""",
    "rel": f"""SELECT a.story_id, b.story_id AS related_id, {_list(RELATIONS)}[a.conv_id % 4 + 1] AS relationship_type,
        (a.conv_id * 13 + b.conv_id) % 1000 / CAST(1000 AS DOUBLE) AS similarity_score
        FROM live a JOIN live b ON b.conv_id = a.conv_id + 1 OR b.conv_id = a.conv_id + 5""",
    "seo": f"""SELECT 'story' AS page_type, concat('conv-', CAST(conv_id AS STRING)) AS page_id,
          substring(text, 1, 5 + conv_id % 50) AS seo_title, substring(text, 1, conv_id % 200) AS seo_description,
          CASE WHEN conv_id % 3 <> 0 THEN substring(text, 1, 5 + conv_id % 50) END AS og_title,
          substring(text, 1, 220) AS og_description, {tokens('text')}[1 : conv_id % 13] AS keywords,
          CAST(turn + 1 AS INTEGER) AS version, turn = last_turn AS active FROM turns
        UNION ALL SELECT 'beat', name, concat('All about ', name), NULL, NULL, NULL, NULL, 1, true FROM topics
        UNION ALL SELECT 'entity', lower(name), concat('All about ', lower(name)), NULL, NULL, NULL, NULL, 1, true FROM ent
        UNION ALL SELECT 'arc', slug, concat('All about ', slug), NULL, NULL, NULL, NULL, 1, true FROM arcs""",
    "verd": "SELECT doc_id AS conv_id, quality = 1 AND toxic = 0 AS quality_passed FROM labels",
    "usage": f"""SELECT user_id AS key_id, {_list([t[0] for t in TIERS])}[user_id % 6 + 1] AS tier,
        CASE WHEN user_id % 6 = 3 THEN 5 ELSE 1 END AS seats, ts AS called_at FROM events""",
    "tiers": f"""SELECT * FROM (VALUES {tier_rows()})
        AS t(tier, per_day, per_minute, hard_day, history_days, seat_minimum)""",
    "deliv": """SELECT event_id AS id, user_id % 10 AS endpoint_id,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
        md5(CAST(event_id // 2 AS STRING)) AS idempotency_key, ts AS attempted_at FROM events""",
    "subs": """SELECT c_custkey AS subscriber_id, CAST(c_custkey % 25 AS INTEGER) AS entity_id,
        ['instant','daily','weekly'][c_custkey % 3 + 1] AS cadence FROM customer""",
    "saved": f"""SELECT item_id AS search_id, array_to_string({tokens('text')}[1:2], ' ') AS query FROM benchmark""",
    "arrivals": """SELECT *, CASE WHEN id % 13 = 0 THEN captured_at + INTERVAL 2 DAY
        ELSE captured_at + INTERVAL 1 MINUTE END AS ingested_at FROM core""",
}
_REF = {name: re.compile(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", re.I) for name in FRAMES}


def _needs(sql: str) -> list[str]:
    return [name for name in FRAMES if _REF[name].search(sql)]


def with_frames(sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _needs(FRAMES[name]):
            if dep != name:
                visit(dep)
        ordered.append(name)

    body = sql.strip()
    for name in _needs(body):
        visit(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({FRAMES[name]})" for name in ordered)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
