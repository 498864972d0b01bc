"""Queries: version chains, arcs, citations and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorascope.functions import text
from agorascope.operators import chains
from agorascope.operators import stories as ops
from agorascope.plans.bindings import slug
from agorascope.plans.read_queries import COMPUTED, computed
from agorascope.plans.registry import query

WORDS = r"len(string_split(trim(regexp_replace({}, '\s+', ' ', 'g')), ' '))"


@query("current_version", """SELECT id, slug, version FROM (SELECT *, row_number() OVER (PARTITION BY slug
    ORDER BY version DESC, id DESC) AS rn FROM st) WHERE rn = 1""")
def _(c):
    return ops.current_version(c.stories.select("id", "slug", "version"))


@query("version_chain", """WITH RECURSIVE walk AS (
      SELECT id, slug, version, id AS root_id, 0 AS steps FROM st WHERE previous_version_id IS NULL
      UNION ALL SELECT s.id, s.slug, s.version, w.root_id, w.steps + 1 FROM st s JOIN walk w ON s.previous_version_id = w.id)
    SELECT w.id, w.slug, w.version, w.root_id, w.steps, n.id AS next_version_id FROM walk w
    LEFT JOIN st n ON n.previous_version_id = w.id""")
def _(c):
    return ops.version_chain(c.stories).select("id", "slug", "version", "root_id", "steps", "next_version_id")


#: Links of some conversations bent into cycles, forks, links to other slugs and to nothing.
BENT = """CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN CAST(conv_id * 100 + 2 AS STRING) WHEN conv_id % 7 = 1 AND turn = 1 THEN CAST((conv_id + 1) * 100 AS STRING)
    WHEN conv_id % 7 = 2 AND turn = 3 THEN CAST(conv_id * 100 + 1 AS STRING) WHEN conv_id % 7 = 3 AND turn = 1 THEN concat('gone-', CAST(conv_id AS STRING))
    WHEN conv_id % 7 = 4 AND turn = 0 THEN CAST(conv_id * 100 AS STRING) ELSE previous_version_id END"""
AUDIT = f"""RECURSIVE bent AS (SELECT id, slug, version, {BENT} AS prev FROM st), link AS (SELECT b.*, p.id AS up, p.slug AS pslug, p.version AS pversion FROM bent b LEFT JOIN bent p ON p.id = b.prev),
    walk AS (SELECT id, id AS cur, [id] AS path, up AS nxt FROM link
      UNION ALL SELECT w.id, l.id, list_append(w.path, l.id), l.up FROM walk w JOIN link l ON l.id = w.nxt WHERE NOT list_contains(w.path, w.nxt)),
    fin AS (SELECT id, cur, len(path) - 1 AS steps, path, nxt FROM walk WHERE nxt IS NULL OR list_contains(path, nxt)),
    after AS (SELECT up, count(*) AS n FROM link WHERE up IS NOT NULL GROUP BY up),
    audit AS (SELECT l.id, l.slug, l.version, CASE WHEN f.nxt IS NULL THEN f.cur END AS root_id, CASE WHEN f.nxt IS NULL THEN f.steps END AS steps,
      CASE WHEN f.nxt IS NOT NULL THEN list_min(f.path[list_position(f.path, f.nxt):]) END AS cycle_id,
      coalesce(list_position(f.path, f.nxt) = 1, false) AS in_cycle, coalesce(a.n, 0) AS successors, l.up IS NULL AND l.prev IS NOT NULL AS dangling,
      l.up IS NOT NULL AND l.pslug <> l.slug AS cross_slug, l.up IS NOT NULL AND l.pversion + 1 <> l.version AS wrong_version
      FROM link l JOIN fin f ON f.id = l.id LEFT JOIN after a ON a.up = l.id)"""


def bent(c):
    return c.stories.withColumn("previous_version_id", F.expr(BENT))


@query("chain_audit", f"WITH {AUDIT} SELECT * FROM audit")
def _(c):
    return chains.chain_audit(bent(c))


@query("faulty_chains", f"""WITH {AUDIT} SELECT slug, count(*) AS versions, count(cycle_id) AS rootless, count_if(in_cycle) AS in_cycles, count_if(successors > 1) AS forks,
    count_if(dangling) AS dangling, count_if(cross_slug) AS cross_slug, count_if(wrong_version) AS wrong_version FROM audit GROUP BY slug
    HAVING count(cycle_id) + count_if(successors > 1 OR dangling OR cross_slug OR wrong_version) > 0""")
def _(c):
    return chains.faulty_chains(bent(c))


@query("version_diff", f"""SELECT s.id, s.slug, s.version, {WORDS.format('s.content')} - {WORDS.format('p.content')} AS word_delta,
    coalesce(array_to_string(list_sort(list_filter(s.source_record_ids, lambda x: NOT list_contains(p.source_record_ids, x))), ','), '') AS sources_added,
    coalesce(array_to_string(list_sort(list_filter(p.source_record_ids, lambda x: NOT list_contains(s.source_record_ids, x))), ','), '') AS sources_removed
    FROM st s JOIN st p ON p.id = s.previous_version_id""")
def _(c):
    return ops.version_diff(c.stories)


@query("version_cadence", """SELECT s.id, s.slug, s.version, CAST(floor(epoch(s.generated_at)) - floor(epoch(p.generated_at)) AS BIGINT)
    AS gap_seconds FROM st s JOIN st p ON p.id = s.previous_version_id
    WHERE floor(epoch(s.generated_at)) - floor(epoch(p.generated_at)) < 180""")
def _(c):
    return ops.version_cadence(c.stories, 3).select("id", "slug", "version", "gap_seconds")


@query("arc_sequence", """SELECT m.arc_id, m.story_id, row_number() OVER (PARTITION BY m.arc_id ORDER BY s.generated_at, m.story_id)
    AS sequence_order FROM arcm m JOIN st s ON s.id = m.story_id""")
def _(c):
    return ops.arc_sequence(c.membership, c.stories).select("arc_id", "story_id", "sequence_order")


@query("chain_integrity", """WITH s AS (SELECT * FROM st WHERE NOT (conv_id % 7 = 0 AND version = 2)),
    j AS (SELECT s.slug, s.version, s.active, s.previous_version_id,
        CASE WHEN s.conv_id % 11 = 0 AND s.version = 1 THEN true ELSE s.active END AS act, p.slug AS ps, p.version AS pv
      FROM s LEFT JOIN s p ON p.id = s.previous_version_id)
    SELECT slug, count(*) AS versions, count_if(act) AS active_versions,
      count_if((previous_version_id IS NOT NULL AND (ps IS NULL OR ps <> slug OR pv + 1 <> version))
        OR (previous_version_id IS NULL AND version > 1)) AS broken_links
    FROM j GROUP BY slug HAVING count_if(act) <> 1 OR count_if(previous_version_id IS NOT NULL AND ps IS NULL) > 0""")
def _(c):
    damaged = c.stories.filter("NOT (conv_id % 7 = 0 AND version = 2)").withColumn(
        "active", F.expr("CASE WHEN conv_id % 11 = 0 AND version = 1 THEN true ELSE active END")
    )
    return ops.chain_integrity(damaged)


@query("supersede_story", """WITH d AS (SELECT slug, concat(CAST(conv_id AS STRING), '-next') AS id FROM st WHERE active AND conv_id % 3 = 0)
    SELECT s.id, s.slug, s.version, s.active AND s.conv_id % 3 <> 0 AS active, s.previous_version_id FROM st s
    UNION ALL SELECT d.id, d.slug, s.version + 1, true, s.id FROM d JOIN st s ON s.slug = d.slug AND s.active""")
def _(c):
    s = c.stories.select("id", "slug", "version", "active", "previous_version_id")
    drafts = c.active_stories.filter("conv_id % 3 = 0").select(
        "slug", F.concat(F.col("conv_id").cast("string"), F.lit("-next")).alias("id")
    )
    return ops.supersede_story(s, drafts)


@query("arc_stats", """SELECT m.arc_id, count(*) AS story_count, CAST(min(s.generated_at) AS STRING) AS first_story_at,
    CAST(max(s.generated_at) AS STRING) AS last_story_at FROM arcm m JOIN st s ON s.id = m.story_id GROUP BY 1""")
def _(c):
    return ops.arc_stats(c.membership, c.stories)


@query("arc_status", """SELECT a.id AS arc_id, a.slug, coalesce((SELECT s.arc_status FROM st s JOIN arcm m ON m.story_id = s.id
      WHERE m.arc_id = a.id AND s.active AND len(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ')) >= 20 ORDER BY s.generated_at DESC, s.id DESC LIMIT 1), 'developing') AS arc_status FROM arcs a""")
def _(c):
    return ops.arc_status(c.arcs, c.membership, c.stories).select("arc_id", "slug", "arc_status")


@query("arc_list", f"""WITH {COMPUTED}, n AS (SELECT m.arc_id, count(*) AS story_count, CAST(max(s.generated_at) AS STRING) AS last_story_at
      FROM arcm m JOIN st s ON s.id = m.story_id GROUP BY 1),
    h AS (SELECT m.arc_id, arg_max(s.computed_arc_status, (s.generated_at, s.id)) AS a, max((s.generated_at, s.id)) AS k
      FROM arcm m JOIN comp s ON s.id = m.story_id WHERE s.active AND len(string_split(trim(regexp_replace(s.content, '\\s+', ' ', 'g')), ' ')) >= 20 GROUP BY 1)
    SELECT a.id AS arc_id, a.slug, a.topic_id, c.computed_arc_status AS arc_status, n.story_count, n.last_story_at FROM arcs a
    LEFT JOIN n ON n.arc_id = a.id LEFT JOIN h ON h.arc_id = a.id LEFT JOIN comp c ON c.id = h.k[2]
    WHERE c.computed_arc_status = 'developing'""")
def _(c):
    return ops.arc_list(c.arcs, c.membership, computed(c).drop("arc_id"), status="developing").select(
        "arc_id", "slug", "topic_id", "arc_status", "story_count", "last_story_at"
    )


@query("entity_arcs", f"""SELECT e.id AS entity_id, m.arc_id, count(DISTINCT r.story_id) AS story_count,
    CAST(max(s.generated_at) AS STRING) AS last_updated_at FROM refs r JOIN ent e ON {slug('e.name')} = r.ref_slug
    JOIN arcm m ON m.story_id = r.story_id JOIN st s ON s.id = r.story_id WHERE r.ref_type = 'entity' GROUP BY 1, 2""")
def _(c):
    return ops.entity_arcs(c.references, c.entities, c.membership, c.stories)


@query("citation_domains", """SELECT domain, platform, fact_type, count(*) AS citations, round(avg(credibility_score), 6) AS mean_credibility
    FROM cit GROUP BY 1, 2, 3""")
def _(c):
    return ops.citation_domains(c.citations)


_CONTENT = "concat(content, CASE WHEN turn % 2 = 0 THEN ' [1] [2] [9]' ELSE ' [1] [3] [3]' END)"


@query("marker_audit", f"""WITH u AS (SELECT DISTINCT id AS story_id, CAST(unnest(regexp_extract_all({_CONTENT}, '\\[([0-9]+)\\]', 1)) AS INTEGER) AS marker
      FROM st)
    SELECT story_id, marker, 'no_citation' AS fault FROM u WHERE NOT EXISTS (SELECT 1 FROM cit c WHERE c.story_id = u.story_id AND c.marker = u.marker)
    UNION ALL SELECT story_id, marker, 'not_in_text' FROM cit c WHERE NOT EXISTS (SELECT 1 FROM u WHERE c.story_id = u.story_id AND c.marker = u.marker)""")
def _(c):
    texts = c.stories.select(F.col("id").alias("story_id"), text.markers(F.expr(_CONTENT)).alias("markers"))
    return ops.marker_audit(texts, c.citations)


@query("explode_sections", """SELECT id AS story_id, i - 1 AS position, parts[i] AS body FROM (SELECT id, string_split(content, chr(10)) AS parts,
    unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM st)""")
def _(c):
    # the stored form: a JSON array of sections, one per line of the story
    lines = F.split("content", "\n")
    stored = c.stories.select("id", F.to_json(F.transform(lines, lambda x, i: F.struct(i.alias("order"), x.alias("body")))).alias("sections"))
    shape = "array<struct<`order`: int, body: string>>"
    return stored.select("id", F.explode(F.from_json("sections", shape)).alias("s")).select(
        F.col("id").alias("story_id"), F.col("s.order").alias("position"), F.col("s.body").alias("body")
    )
