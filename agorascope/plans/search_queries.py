"""Queries: text, keyword and vector search, search projections and index state."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorascope.operators import postings, search, textual, vector_index, vectorial
from agorascope.plans.bindings import cosine, slug, tokens
from agorascope.plans.join_queries import matches
from agorascope.plans.read_queries import S_TIME, s_as_of
from agorascope.plans.registry import query
from agorascope.session import stored

QUERY = "the er CH"  # analysed to two terms; "the" is on the stop list
BM25 = """tk AS (SELECT id, {tokens} AS w FROM {frame}), tf AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'er')) AS a,
      len(list_filter(w, lambda x: x = 'ch')) AS b FROM tk),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(n) AS al, CAST(count_if(a > 0) AS DOUBLE) AS da, CAST(count_if(b > 0) AS DOUBLE) AS db FROM tf),
    hits AS (SELECT id, ln(1.0 + (s.n - da + 0.5) / (da + 0.5)) * a * CAST(2.2 AS DOUBLE) / (a + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * tf.n / al))
      + ln(1.0 + (s.n - db + 0.5) / (db + 0.5)) * b * CAST(2.2 AS DOUBLE) / (b + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * tf.n / al)) AS score
      FROM tf, s WHERE a > 0 AND b > 0)"""
STORY_TEXT = "concat_ws(' ', headline, synopsis, content)"


@query("fulltext_search", f"""WITH {BM25.format(tokens=tokens(STORY_TEXT), frame="(SELECT * FROM st WHERE active)")}
    SELECT id, round(score, 6) AS score FROM hits""")
def _(c):
    rows = textual.fulltext_search(c.active_stories.select("id", "headline", "synopsis", "content"), F.expr(STORY_TEXT), QUERY)
    return rows.select("id", F.round("score", 6).alias("score"))


def _postings(c):
    return postings.write(c.documents.select(F.col("doc_id").alias("id"), "text"), F.col("text"), block_docs=256)


DOC_BM25 = BM25.format(tokens=tokens("coalesce(text, '')"), frame="(SELECT doc_id AS id, text FROM documents)")


@query("postings_search", f"WITH {DOC_BM25} SELECT id, round(score, 6) AS score FROM hits")
def _(c):
    return postings.search(_postings(c), QUERY).withColumn("score", F.round("score", 6))


@query("postings_top", f"WITH {DOC_BM25} SELECT id, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, id LIMIT 10")
def _(c):
    return postings.top(_postings(c), QUERY, 10).withColumn("score", F.round("score", 6))


@query("postings_phrase", f"""WITH w AS (SELECT doc_id AS id, {tokens("coalesce(text, '')")} AS w FROM documents),
    p AS (SELECT id, w, unnest(range(1, len(w))) AS i FROM w) SELECT id, i - 1 AS start FROM p WHERE w[i] = 'er' AND w[i + 1] = 'ch'""")
def _(c):
    return postings.phrase(_postings(c), ["er", "ch"])


_HYBRID_ROWS = """(SELECT id, content_text FROM rec WHERE category = 'discourse' AND captured_at >= TIMESTAMP '2024-01-01 06:00:00'
    AND id IN (SELECT record_id FROM ta))"""


@query("hybrid_search", f"""WITH {BM25.format(tokens=tokens('content_text'), frame=_HYBRID_ROWS)},
    kw AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM hits),
    vq AS (SELECT v.vec_id AS id, round({cosine('v.embedding', 'q.embedding')}, 9) AS sim FROM embeddings v, embeddings q
      WHERE q.vec_id = 3 AND v.vec_id IN (SELECT id FROM {_HYBRID_ROWS})),
    ve AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS r FROM vq),
    f AS (SELECT coalesce(k.id, v.id) AS record_id, k.r AS keyword_rank, v.r AS vector_rank,
      coalesce(1.0 / CAST(60 + k.r AS DOUBLE), 0) + coalesce(1.0 / CAST(60 + v.r AS DOUBLE), 0) AS score
      FROM kw k FULL JOIN ve v ON k.id = v.id)
    SELECT record_id, keyword_rank, vector_rank, round(score, 9) AS score FROM f ORDER BY f.score DESC, record_id LIMIT 10""")
def _(c):
    rows = c.records_text.filter(
        (F.col("category") == "discourse") & (F.col("captured_at") >= F.lit("2024-01-01 06:00:00").cast("timestamp"))
    ).select(F.col("id").alias("record_id"), "content_text")
    rows = rows.join(c.assignments.select("record_id"), "record_id", "left_semi")
    hits = search.hybrid_search(rows, "content_text", QUERY, c.vectors, vectorial.vector_of(c.vectors, 3))
    return hits.withColumn("score", F.round("score", 9))


DOCS = f"""docs AS (SELECT 'story' AS kind, s.id AS entity_id, headline AS title, s.topic_id, t.name AS topic_name, NULL AS source_kind,
      s.type AS story_type, concat('/story/', slug) AS url, strftime(generated_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS published_at, slug
      FROM st s LEFT JOIN topics t ON t.id = s.topic_id WHERE active
    UNION ALL SELECT 'record', CAST(id AS STRING), coalesce(title, concat(kind, '/', external_id)), NULL, NULL, kind, NULL, url,
      strftime(captured_at, '%Y-%m-%dT%H:%M:%S.%gZ'), NULL FROM rec
    UNION ALL SELECT 'entity', CAST(id AS STRING), name, NULL, NULL, NULL, NULL, concat('/entity/', {slug('name')}), NULL, {slug('name')} FROM ent
    UNION ALL SELECT 'topic', CAST(id AS STRING), display_name, id, name, NULL, NULL, concat('/beat/', name), NULL, name FROM topics)"""


@query("search_index_docs", f"WITH {DOCS} SELECT * FROM docs")
def _(c):
    return search.search_index_docs(c.stories, c.records_url, c.entities, c.topics)


@query("quick_search", f"""WITH {DOCS} SELECT kind, entity_id, title, CASE WHEN lower(title) = 'article 12' THEN CAST(1.0 AS DOUBLE)
      WHEN starts_with(lower(title), 'article 12') THEN 0.8 WHEN contains(lower(title), ' article 12') THEN 0.6 ELSE 0.4 END AS score
    FROM docs WHERE contains(lower(title), 'article 12') ORDER BY score DESC, kind, entity_id LIMIT 8""")
def _(c):
    docs = search.search_index_docs(c.stories, c.records_url, c.entities, c.topics)
    return search.quick_search(docs, "Article 12").select("kind", "entity_id", "title", "score")


PROJ = f"""proj AS (SELECT 'story' AS kind, s.id AS entity_id, headline AS title, s.topic_id, t.name AS topic_name, s.type AS story_type,
      concat('/story/', slug) AS url, strftime(generated_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS published_at, slug, CAST(NULL AS STRING) AS story_id,
      CAST(NULL AS STRING) AS citation_type, CAST(NULL AS STRING) AS record_id, CAST(NULL AS STRING) AS domain, CAST(NULL AS STRING) AS source_kind
      FROM st s LEFT JOIN topics t ON t.id = s.topic_id WHERE active
    UNION ALL SELECT 'citation', concat(story_id, '/', marker), coalesce(domain, concat('record ', record_id)), NULL, NULL, NULL, external_url,
      NULL, NULL, story_id, citation_type, CAST(record_id AS STRING), domain, platform FROM cit WHERE story_id IN (SELECT id FROM st WHERE active)
    UNION ALL SELECT 'entity', CAST(id AS STRING), name, NULL, NULL, NULL, concat('/entity/', {slug('name')}), NULL, {slug('name')},
      NULL, NULL, NULL, NULL, NULL FROM ent
    UNION ALL SELECT 'topic', CAST(id AS STRING), display_name, id, name, NULL, concat('/beat/', name), NULL, name,
      NULL, NULL, NULL, NULL, NULL FROM topics)"""


@query("search_projection", f"WITH {PROJ} SELECT * FROM proj")
def _(c):
    return search.search_projection(c.stories, c.citations, c.entities, c.topics)


@query("content_hash", "SELECT id, sha256(content) AS content_hash FROM st WHERE active")
def _(c):
    return c.active_stories.select("id", search.content_hash(F.col("content")).alias("content_hash"))


@query("search_reconcile", """WITH ck AS (SELECT * FROM (VALUES ('story', TIMESTAMP '2024-01-02 00:00:00', ''), ('citation', TIMESTAMP '1970-01-01 00:00:00', '')) v(kind, t, i)),
    r AS (SELECT 'story' AS kind, id, generated_at AS u FROM st UNION ALL SELECT 'citation', concat(c.story_id, '/', c.marker), s.generated_at
      FROM cit c JOIN st s ON s.id = c.story_id),
    d AS (SELECT r.*, row_number() OVER (PARTITION BY r.kind ORDER BY u, r.id) AS rn FROM r JOIN ck ON ck.kind = r.kind AND (u > t OR (u = t AND r.id > i))),
    p AS (SELECT * FROM d WHERE rn <= 100)
    SELECT ck.kind, CAST(coalesce(max(p.u), any_value(ck.t)) AS STRING) AS last_synced_at, coalesce(arg_max(p.id, p.rn), '') AS last_id, count(p.id) AS uploaded
    FROM ck LEFT JOIN p ON p.kind = ck.kind GROUP BY ck.kind""")
def _(c):
    rows = c.stories.select(F.lit("story").alias("kind"), "id", F.col("generated_at").alias("updated_at")).union(
        c.citations.join(c.stories.select(F.col("id").alias("story_id"), "generated_at"), "story_id").select(
            F.lit("citation"), F.concat_ws("/", "story_id", "marker"), "generated_at")
    )
    marks = c.spark.createDataFrame(
        [("story", "2024-01-02 00:00:00", ""), ("citation", "1970-01-01 00:00:00", "")], "kind string, t string, last_id string"
    ).select("kind", F.col("t").cast("timestamp").alias("last_synced_at"), "last_id")
    return search.advance_checkpoints(marks, search.reconcile(rows, marks, 100))


@query("projection_diff", """WITH cur AS (SELECT 'story' AS kind, slug AS entity_id, sha256(content) AS h FROM st WHERE active),
    old AS (SELECT 'story' AS kind, s.slug AS entity_id, sha256(CASE WHEN s.conv_id % 2 = 0 THEN s.content ELSE coalesce(p.content, 'x') END) AS h,
        CASE WHEN s.conv_id % 10 = 8 THEN 'failed' ELSE 'synced' END AS status, CASE WHEN s.conv_id % 10 = 8 THEN 2 ELSE 0 END AS attempts
      FROM st s LEFT JOIN st p ON p.id = s.previous_version_id WHERE s.active AND s.conv_id % 10 <> 5
      UNION ALL SELECT 'story', concat('gone-', conv_id), sha256(content), 'synced', 0 FROM st WHERE active AND conv_id % 10 = 6),
    d AS (SELECT coalesce(c.kind, o.kind) AS kind, coalesce(c.entity_id, o.entity_id) AS entity_id, c.h AS n, o.h AS o, o.status, o.attempts,
      CASE WHEN c.h IS NULL THEN 'delete' WHEN o.status IS NULL THEN 'insert' WHEN c.h <> o.h THEN 'update' WHEN o.status = 'synced' THEN 'none'
        ELSE 'update' END AS action FROM cur c FULL JOIN old o ON o.kind = c.kind AND o.entity_id = c.entity_id)
    SELECT kind, entity_id, action,
      CASE WHEN bad THEN o WHEN action = 'delete' THEN o ELSE coalesce(n, o) END AS content_hash,
      CASE WHEN bad THEN 'failed' WHEN action = 'delete' THEN 'deleted' WHEN action <> 'none' THEN 'synced' ELSE status END AS status,
      CASE WHEN bad THEN coalesce(attempts, 0) + 1 WHEN action <> 'none' THEN 0 ELSE coalesce(attempts, 0) END AS attempts
    FROM (SELECT *, action <> 'none' AND entity_id LIKE '%7' AS bad FROM d)""")
def _(c):
    live = c.active_stories
    current = live.select(
        F.lit("story").alias("kind"), F.col("slug").alias("entity_id"), search.content_hash(F.col("content")).alias("content_hash")
    )
    prev = c.stories.select(F.col("id").alias("previous_version_id"), F.col("content").alias("prev_content"))
    known = live.filter("conv_id % 10 <> 5").join(prev, "previous_version_id", "left").select(
        F.lit("story").alias("kind"), F.col("slug").alias("entity_id"),
        search.content_hash(F.expr("CASE WHEN conv_id % 2 = 0 THEN content ELSE coalesce(prev_content, 'x') END")).alias("content_hash"),
        F.expr("CASE WHEN conv_id % 10 = 8 THEN 'failed' ELSE 'synced' END").alias("status"),
        F.expr("CASE WHEN conv_id % 10 = 8 THEN 2 ELSE 0 END").alias("attempts"),
    )
    gone = live.filter("conv_id % 10 = 6").select(
        F.lit("story"), F.concat(F.lit("gone-"), F.col("conv_id").cast("string")), search.content_hash(F.col("content")),
        F.lit("synced"), F.lit(0),
    )
    diff = search.projection_diff(current, known.union(gone))
    return search.next_state(diff, diff.filter(F.col("entity_id").endswith("7")))


# ---- text -----------------------------------------------------------------------------------
@query("top_entity", """SELECT record_id, entity_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY record_id
    ORDER BY confidence DESC, coalesce(start_offset, 2147483647), entity_id) AS rn FROM ment) WHERE rn = 1""")
def _(c):
    from agorascope.operators.stories import top_entity

    return top_entity(c.mentions).select("record_id", "entity_id", "confidence")


@query("assign_topics_keyword", f"""SELECT DISTINCT r.id AS record_id, t.topic_id, 'keyword' AS method, CAST(NULL AS DOUBLE) AS confidence
    FROM (SELECT doc_id, unnest(list_distinct({tokens('text')})) AS w FROM documents) d JOIN core r ON r.doc_id = d.doc_id
    JOIN (SELECT id AS topic_id, unnest(keywords) AS w FROM topics) t ON t.w = d.w""")
def _(c):
    texts = c.documents.select(F.col("doc_id").alias("record_id"), "text")
    return textual.assign_topics_keyword(texts, c.topics, c.core.select(F.col("id").alias("record_id"), F.col("doc_id").alias("text_id")))


@query("extract_mentions", f"""WITH dict AS (SELECT id * 2 + i - 1 AS entity_id, keywords[i] AS name FROM topics, (VALUES (1), (2)) v(i)),
    d AS (SELECT doc_id, {tokens('text')} AS w, regexp_split_to_array(lower(text), '[\\p{{L}}\\p{{N}}]+') AS sep FROM documents),
    o AS (SELECT doc_id, i, w[i] AS word, w, sep FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
    h AS (SELECT o.*, dict.entity_id FROM o JOIN dict ON dict.name = o.word),
    s AS (SELECT doc_id AS record_id, entity_id, CAST(coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)
      + list_sum(list_transform(sep[1:i], lambda x: length(x))) AS BIGINT) AS start_offset, length(word) AS n FROM h)
    SELECT record_id, entity_id, start_offset, start_offset + n AS end_offset FROM s""")
def _(c):
    words = c.topics.select("id", F.posexplode("keywords").alias("i", "name"))
    dictionary = words.select((F.col("id") * 2 + F.col("i")).alias("entity_id"), "name")
    texts = c.documents.select(F.col("doc_id").alias("record_id"), "text")
    return textual.extract_mentions(texts, dictionary)


def story_texts(c):
    """Active and superseded stories as texts of a recent and a baseline window."""
    recent = F.col("generated_at") > s_as_of() - F.expr("INTERVAL 2 DAYS")
    inside = (F.col("generated_at") <= s_as_of()) & (F.col("generated_at") > s_as_of() - F.expr("INTERVAL 4 DAYS"))
    return c.stories.filter(inside).select(
        F.col("content").alias("text"), recent.cast("long").alias("recent"), (~recent).cast("long").alias("baseline"), "conv_id"
    )


def record_texts(c, recent_days: int = 7, baseline_days: int = 21):
    """Texts of records with how often each occurs in either window; copies are counted, not repeated."""
    t, now = F.col("captured_at"), c.as_of
    split = now - F.make_dt_interval(days=F.lit(recent_days))
    start = now - F.make_dt_interval(days=F.lit(recent_days + baseline_days))
    weights = c.core.filter((t > start) & (t <= now)).groupBy("doc_id").agg(
        F.count_if(t > split).alias("recent"), F.count_if(t <= split).alias("baseline")
    )
    docs = c.documents.select("doc_id", "text")
    return weights.join(docs, "doc_id").select("text", "recent", "baseline")


STORY_TEXTS = f"""stx AS (SELECT content AS text, CAST(generated_at > {S_TIME} - INTERVAL 2 DAY AS BIGINT) AS recent,
      CAST(generated_at <= {S_TIME} - INTERVAL 2 DAY AS BIGINT) AS baseline FROM st WHERE generated_at <= {S_TIME}
      AND generated_at > {S_TIME} - INTERVAL 4 DAY)"""
RECORD_TEXTS = """rtx AS (SELECT d.text, w.recent, w.baseline FROM (SELECT doc_id,
      count_if(captured_at > TIMESTAMP '2024-01-24 00:00:00') AS recent, count_if(captured_at <= TIMESTAMP '2024-01-24 00:00:00') AS baseline
      FROM core WHERE captured_at > TIMESTAMP '2024-01-03 00:00:00' GROUP BY doc_id) w JOIN documents d ON d.doc_id = w.doc_id)"""


def grams(frame: str, name: str, sizes: tuple[int, ...]) -> str:
    """SQL counting n-grams of a texts frame."""
    one = """SELECT {n} AS n, array_to_string(w[i:i + {n} - 1], ' ') AS ngram, recent, baseline FROM (
        SELECT w, recent, baseline, unnest(range(1, len(w) - {n} + 2)) AS i FROM {name}_w)"""
    union = " UNION ALL ".join(one.format(n=n, name=name) for n in sizes)
    return f"""{name}_w AS (SELECT {tokens('text')} AS w, recent, baseline FROM {frame}),
    {name} AS (SELECT n, ngram, CAST(sum(recent) AS BIGINT) AS recent_n, CAST(sum(baseline) AS BIGINT) AS baseline_n FROM ({union}) GROUP BY n, ngram)"""


DELTA = """SELECT n, ngram, recent_n, baseline_n, round(delta, 9) AS delta FROM (SELECT *, recent_n / CAST(sum(recent_n) OVER (PARTITION BY n) AS DOUBLE)
      - coalesce(baseline_n / nullif(CAST(sum(baseline_n) OVER (PARTITION BY n) AS DOUBLE), 0), 0) AS delta FROM {name})
    WHERE delta >= {d} AND recent_n >= {m}"""


@query("ngram_delta", f"WITH {STORY_TEXTS}, {grams('stx', 'g', (1, 2, 3))} {DELTA.format(name='g', d=0.00005, m=3)}")
def _(c):
    return textual.ngram_delta(story_texts(c)).withColumn("delta", F.round("delta", 9))


@query("key_phrase_trending", f"WITH {RECORD_TEXTS}, {grams('rtx', 'g', (2,))} {DELTA.format(name='g', d=0.00001, m=3)}")
def _(c):
    return textual.ngram_delta(record_texts(c), 2, 2, min_delta=0.00001).withColumn("delta", F.round("delta", 9))


_STOPS = "[" + ", ".join(f"'{w}'" for w in textual.STOP_WORDS) + "]"


def _shape_sql(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda x: CASE WHEN list_contains({_STOPS}, x) THEN x ELSE 'X' END), ' ')"


@query("opening_fingerprints", f"""WITH w AS (SELECT {tokens('content')} AS w, {tokens('headline')} AS h FROM st WHERE active),
    p AS (SELECT 'opening' AS part, {_shape_sql('w[1:6]')} AS fingerprint FROM w
      UNION ALL SELECT 'closing', {_shape_sql('w[greatest(len(w) - 6, 0) + 1 : len(w)]')} FROM w
      UNION ALL SELECT 'headline', {_shape_sql('h[1:6]')} FROM w)
    SELECT part, fingerprint, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY part) AS DOUBLE), 9) AS share FROM p GROUP BY 1, 2""")
def _(c):
    return textual.shapes(c.active_stories).withColumn("share", F.round("share", 9))


@query("ngram_vs_source", f"""WITH o AS (SELECT content AS text, 1 AS recent, 0 AS baseline FROM st WHERE active), {RECORD_TEXTS.replace('rtx AS', 'r0 AS')},
    s0 AS (SELECT text, recent + baseline AS recent, 0 AS baseline FROM r0), {grams('o', 'og', (1,))}, {grams('s0', 'sg', (1,))},
    j AS (SELECT og.ngram, og.recent_n AS output_n, sg.recent_n AS source_n, (og.recent_n / CAST((SELECT sum(recent_n) FROM og) AS DOUBLE))
      / ((coalesce(sg.recent_n, 0) + 1) / CAST((SELECT sum(recent_n) FROM sg) AS DOUBLE)) AS ratio
      FROM og LEFT JOIN sg ON sg.ngram = og.ngram WHERE og.recent_n >= 3)
    SELECT ngram, output_n, source_n, round(ratio, 6) AS ratio FROM j WHERE ratio >= 2.0""")
def _(c):
    ours = c.active_stories.select(F.col("content").alias("text"), F.lit(1).alias("recent"), F.lit(0).alias("baseline"))
    theirs = record_texts(c).select("text", (F.col("recent") + F.col("baseline")).alias("recent"), F.lit(0).alias("baseline"))
    return textual.ngram_vs_source(ours, theirs).withColumn("ratio", F.round("ratio", 6))


#: Stories of the run at hand: those generated within a day of the newest one.
RUN = "(SELECT id FROM st WHERE active AND generated_at > (SELECT max(generated_at) FROM st WHERE active) - INTERVAL 1 DAY)"


def run_of(stories: DataFrame) -> DataFrame:
    newest = stories.agg(F.max("generated_at")).scalar()
    return stories.filter(F.col("generated_at") > newest - F.expr("INTERVAL 1 DAY")).select("id")


@query("saturated_candidates", f"""WITH a AS (SELECT id, topic_id, generated_at, list_distinct({tokens('content')}) AS w FROM st WHERE active AND topic_id IS NOT NULL),
    j AS (SELECT a.topic_id, b.id AS candidate_id, a.id, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y
      FROM a JOIN a b ON b.topic_id = a.topic_id AND b.id <> a.id AND b.id IN {RUN} AND a.generated_at <= b.generated_at
      AND a.generated_at > b.generated_at - INTERVAL 14 DAY)
    SELECT topic_id, candidate_id, id, round(i / CAST(x + y - i AS DOUBLE), 6) AS jaccard FROM j WHERE round(i / CAST(x + y - i AS DOUBLE), 6) >= 0.05""")
def _(c):
    return textual.saturated_candidates(c.stories, run_of(c.stories.filter("active")), 0.05)


# ---- vectors --------------------------------------------------------------------------------
@query("similar_records", f"""SELECT v.vec_id AS record_id, round({cosine('v.embedding', 'q.embedding')}, 6) AS similarity FROM embeddings v,
    embeddings q WHERE q.vec_id = 7 AND v.vec_id <> 7 ORDER BY {cosine('v.embedding', 'q.embedding')} DESC, v.vec_id LIMIT 20""")
def _(c):
    return vectorial.similar_records(c.vectors, 7, 20).withColumn("similarity", F.round("similarity", 6))


NEIGHBOURS = f"""SELECT q.vec_id AS query_id, v.vec_id AS record_id, round({cosine('v.embedding', 'q.embedding')}, 9) AS similarity
    FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0"""


@query("similar_records_exact", f"""SELECT query_id, record_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY similarity DESC, record_id) AS rank FROM ({NEIGHBOURS})) WHERE rank <= 10""")
def _(c):
    asked = c.vectors.filter("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "vector")
    return vector_index.search_exact(c.vectors, asked, 10).withColumn("similarity", F.round("similarity", 6))


@query("similar_records_ann", f"""SELECT query_id, record_id, round(similarity, 6) AS similarity, rank, true AS recall_reached FROM (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, record_id) AS rank FROM ({NEIGHBOURS})) WHERE rank <= 10""")
def _(c):
    """The exact neighbours of every id divisible by 20, and whether the index found at least nine in ten of them."""
    asked = c.vectors.filter("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "vector")
    index = vector_index.build(c.vectors)
    found = stored(vector_index.search(index, asked, 10, vector_index.tune(index, c.vectors, asked, 10)), "found")
    exact = stored(vector_index.search_exact(c.vectors, asked, 10), "exact")
    return exact.withColumn("similarity", F.round("similarity", 6)).withColumn("recall_reached", vector_index.recall(found, exact) >= 0.9)


TOPIC_VECTORS = "(SELECT vec_id, label AS topic_id, embedding FROM embeddings)"


@query("topic_centroids", """SELECT topic_id, i AS position, round(avg(v), 6) AS value FROM (SELECT label AS topic_id,
    unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY 1, 2""")
def _(c):
    cents = vectorial.topic_centroids(c.vectors.withColumnRenamed("cluster", "topic_id"))
    return cents.select("topic_id", F.posexplode("centroid").alias("position", "v")).select(
        "topic_id", "position", F.round("v", 6).alias("value")
    )


_CENTS = """ce AS (SELECT topic_id, list(a ORDER BY i) AS c FROM (SELECT label AS topic_id, i, avg(v) AS a FROM (SELECT label,
      unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


@query("assign_topics_centroid", f"""WITH {_CENTS}, s AS (SELECT vec_id AS record_id, topic_id, round({cosine('embedding', 'c')}, 6) AS s FROM embeddings, ce),
    r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY s DESC, topic_id) AS rn FROM s)
    SELECT record_id, topic_id, 'cluster' AS method, s AS confidence FROM r WHERE rn = 1 AND s >= 0.1""")
def _(c):
    cents = vectorial.topic_centroids(c.vectors.withColumnRenamed("cluster", "topic_id"))
    clusters = c.vectors.select("cluster").distinct().count()
    return vectorial.assign_topics_centroid(c.vectors, cents, clusters, 0.1, block=4)


@query("assign_topics_cluster")
def _(c):
    return vectorial.assign_topics_cluster(c.vectors, 10)


@query("related_stories", f"""WITH a AS (SELECT s.id, s.topic_id, v.embedding FROM st s JOIN embeddings v ON v.vec_id = s.conv_id WHERE s.active),
    j AS (SELECT b.id AS story_id, a.id AS related_id, round({cosine('a.embedding', 'b.embedding')}, 3) AS similarity_score
      FROM a JOIN a b ON b.topic_id = a.topic_id AND b.id <> a.id AND b.id IN {RUN})
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY similarity_score DESC, related_id) AS rank FROM j) WHERE rank <= 3""")
def _(c):
    live = c.active_stories.select("id", "topic_id", "generated_at", "conv_id")
    vecs = live.join(c.vectors.select(F.col("record_id").alias("conv_id"), "vector"), "conv_id").select("id", "vector")
    return vectorial.related_stories(live.select("id", "topic_id"), vecs, run_of(live), 3)


@query("embedding_model_ab", f"""WITH a AS (SELECT v.vec_id FROM embeddings v, embeddings q WHERE q.vec_id = 7 AND v.vec_id <> 7
      ORDER BY {cosine('v.embedding', 'q.embedding')} DESC, v.vec_id LIMIT 20),
    b AS (SELECT v.vec_id FROM embeddings v, embeddings q WHERE q.vec_id = 7 AND v.vec_id <> 7
      ORDER BY {cosine('v.embedding[1:32]', 'q.embedding[1:32]')} DESC, v.vec_id LIMIT 20)
    SELECT model_name, count(DISTINCT record_id) AS records, max(len(vector)) AS dimensions,
      (SELECT count(*) FROM a JOIN b ON a.vec_id = b.vec_id) AS shared_neighbours FROM emb GROUP BY 1""")
def _(c):
    return vectorial.model_overlap(c.embeddings, "m64", "m32", 7, 20)


# ---- webhook payloads -----------------------------------------------------------------------
def _uuid(h: str) -> str:
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "concat_ws('-', " + ", ".join(f"substring({h}, {a}, {n})" for a, n in cut) + ")"


def _envelope(kind: str, key: str, at: str, fields: list[tuple[str, str, str]], frame: str) -> str:
    """Oracle SQL for one event type; ``fields`` are (name, expression, text|number)."""
    parts = []
    for name, expr, typ in fields:
        quoted = f"coalesce(CAST(to_json(CAST({expr} AS STRING)) AS STRING), 'null')" if typ == "text" else f"coalesce(CAST({expr} AS STRING), 'null')"
        parts.append(f"'\"{name}\":', {quoted}")
    body = ", ',', ".join(parts)
    h = f"md5(concat('{kind}', '|', {key}))"
    return f"SELECT '{kind}' AS event_type, {_uuid(h)} AS idempotency_key, {at} AS created_at, concat('{{', {body}, '}}') AS data FROM {frame}"


def _iso(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%dT%H:%M:%S.%gZ')"


_PAYLOAD_SQL = " UNION ALL ".join([
    _envelope("story.published", "id", _iso("generated_at"), [
        ("story_id", "id", "text"), ("slug", "slug", "text"), ("type", "type", "text"), ("topic_id", "topic_id", "number"),
        ("entity_name", "entity_name", "text"), ("version", "version", "number"), ("generated_at", _iso("generated_at"), "text"),
        ("publish_at", _iso("publish_at"), "text")], "(SELECT * FROM st WHERE active)"),
    _envelope("signal.detected", "CAST(id AS STRING)", _iso("detected_at"), [
        ("signal_id", "id", "number"), ("kind", "kind", "text"), ("severity", "severity", "text"), ("score", "score", "number"),
        ("headline", "headline", "text"), ("topic_id", "topic_id", "number"), ("detected_at", _iso("detected_at"), "text")], "sig"),
    _envelope("entity.mentioned", "concat(entity_id, '/', record_id)", _iso("captured_at"), [
        ("entity_id", "entity_id", "number"), ("entity_name", "name", "text"), ("entity_type", "type", "text"),
        ("entity_slug", slug("name"), "text"), ("record_id", "CAST(record_id AS STRING)", "text"), ("confidence", "confidence", "number")],
        "(SELECT m.record_id, m.entity_id, max(m.captured_at) AS captured_at, max(m.confidence) AS confidence, e.name, e.type FROM ment m "
        "JOIN ent e ON e.id = m.entity_id GROUP BY ALL)"),
    _envelope("arc.updated", "CAST(arc_id AS STRING)", _iso("t"), [
        ("arc_id", "arc_id", "number"), ("arc_slug", "concat('arc-', arc_id)", "text"), ("story_count", "n", "number"),
        ("updated_at", _iso("t"), "text")],
        "(SELECT m.arc_id, count(*) AS n, max(s.generated_at) AS t FROM arcm m JOIN st s ON s.id = m.story_id GROUP BY 1)"),
    _envelope("saved_search.matched", "CAST(search_id AS STRING)", f"'{'2024-01-05T00:00:00.000Z'}'", [
        ("saved_search_id", "CAST(search_id AS STRING)", "text"), ("match_count", "n", "number")],
        "(SELECT search_id, count(*) AS n FROM (SELECT q.search_id, s.id FROM (SELECT id, concat(' ', array_to_string("
        + tokens("content") + ", ' '), ' ') AS flat FROM st WHERE active) s JOIN saved q ON contains(s.flat, concat(' ', q.query, ' '))) GROUP BY 1)"),
])


@query("webhook_payloads", _PAYLOAD_SQL)
def _(c):
    from agorascope.operators.alerts import webhook_payloads
    from agorascope.operators.stories import arc_stats

    found = matches(c).groupBy("search_id").agg(F.count(F.lit(1)).alias("match_count")).withColumn("matched_at", s_as_of())
    return webhook_payloads(
        c.active_stories, c.signals, c.mentions, c.entities, arc_stats(c.membership, c.stories), c.arcs, found
    ).drop("id")


