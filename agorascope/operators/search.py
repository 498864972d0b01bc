"""Search documents, ranking, and the state of an external search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorascope.functions.rules import iso_ms
from agorascope.functions.text import slug
from agorascope.functions.vectors import cosine
from agorascope.params import P
from agorascope.schemas import SEARCH_KINDS
from agorascope.session import stored

PROJECTION_COLUMNS = (
    "kind", "entity_id", "title", "topic_id", "topic_name", "story_type", "url", "published_at", "slug", "story_id",
    "citation_type", "record_id", "domain", "source_kind",
)
INDEX_COLUMNS = (
    "kind", "entity_id", "title", "topic_id", "topic_name", "source_kind", "story_type", "url", "published_at", "slug",
)


def _shape(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Exactly ``columns``, absent ones as explicit NULLs."""
    text = {c for c in columns if c != "topic_id"}
    return frame.select(*[
        (F.col(c) if c in frame.columns else F.lit(None)).cast("string" if c in text else "int").alias(c) for c in columns
    ])


def _stories(stories: DataFrame, topics: DataFrame) -> DataFrame:
    names = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"))
    return stories.filter("active").join(names, "topic_id", "left").select(
        F.lit("story").alias("kind"), F.col("id").alias("entity_id"), F.col("headline").alias("title"), "topic_id", "topic_name",
        F.col("type").alias("story_type"), F.concat(F.lit("/story/"), "slug").alias("url"),
        iso_ms(F.col("generated_at")).alias("published_at"), "slug",
    )


def _entities(entities: DataFrame) -> DataFrame:
    s = slug(F.col("name"))
    return entities.select(
        F.lit("entity").alias("kind"), F.col("id").cast("string").alias("entity_id"), F.col("name").alias("title"),
        F.concat(F.lit("/entity/"), s).alias("url"), s.alias("slug"),
    )


def _topics(topics: DataFrame) -> DataFrame:
    return topics.select(
        F.lit("topic").alias("kind"), F.col("id").cast("string").alias("entity_id"), F.col("display_name").alias("title"),
        F.col("id").alias("topic_id"), F.col("name").alias("topic_name"), F.concat(F.lit("/beat/"), "name").alias("url"),
        F.col("name").alias("slug"),
    )


def search_projection(stories: DataFrame, citations: DataFrame, entities: DataFrame, topics: DataFrame) -> DataFrame:
    """Stories, their citations, entities and topics in one 14-column shape; records stay out."""
    live = stories.filter("active").select(F.col("id").alias("story_id"))
    cited = citations.join(live, "story_id", "left_semi").select(
        F.lit("citation").alias("kind"), F.concat_ws("/", "story_id", "marker").alias("entity_id"),
        F.coalesce("domain", F.concat(F.lit("record "), F.col("record_id").cast("string"))).alias("title"),
        F.col("external_url").alias("url"), "story_id", "citation_type", F.col("record_id").cast("string").alias("record_id"),
        "domain", F.col("platform").alias("source_kind"),
    )
    parts = [_stories(stories, topics), cited, _entities(entities), _topics(topics)]
    out = _shape(parts[0], PROJECTION_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(_shape(part, PROJECTION_COLUMNS))
    return out


def search_index_docs(stories: DataFrame, records: DataFrame, entities: DataFrame, topics: DataFrame) -> DataFrame:
    """Stories, records, entities and topics in the older 10-column shape."""
    recs = records.select(
        F.lit("record").alias("kind"), F.col("id").cast("string").alias("entity_id"),
        F.coalesce("title", F.concat_ws("/", "kind", "external_id")).alias("title"), F.col("kind").alias("source_kind"),
        "url", iso_ms(F.col("captured_at")).alias("published_at"),
    )
    out = _shape(_stories(stories, topics), INDEX_COLUMNS)
    for part in (recs, _entities(entities), _topics(topics)):
        out = out.unionByName(_shape(part, INDEX_COLUMNS))
    return out


def quick_search(documents: DataFrame, q: str, limit: int = 8) -> DataFrame:
    """Best ``limit`` (at most 20) titles: equal 1.0, prefix 0.8, word prefix 0.6, inside 0.4."""
    t, needle = F.lower("title"), q.lower()
    score = (
        F.when(t == needle, 1.0).when(F.startswith(t, F.lit(needle)), 0.8)
        .when(F.contains(t, F.lit(" " + needle)), 0.6).when(F.contains(t, F.lit(needle)), 0.4)
    )
    hits = documents.withColumn("score", score).filter(F.col("score").isNotNull())
    return hits.orderBy(F.desc("score"), "kind", "entity_id").limit(max(1, min(limit, 20)))


def ranked(frame: DataFrame, key: str, score: str, depth: int, name: str) -> DataFrame:
    """The first ``depth`` rows by score with their rank; numbering runs over those rows only."""
    top = frame.select(key, score).orderBy(F.desc(score), key).limit(depth)
    return top.select(key, F.row_number().over(W.orderBy(F.desc(score), key)).alias(name))


def true_ranks(scored: DataFrame, seeds: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """(key, rank in all of ``scored``) of those few ``seeds`` that are in it, without sorting the list.

    The seeds' own order is an array; each row tells how many seeds precede it, rows are counted by that number, and a
    seed's rank is the sum of the counts up to its own place. ``scored`` has one row a key.
    """
    mine = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
    packed = scored.join(F.broadcast(seeds.select(key)), key).agg(F.sort_array(F.collect_list(mine)).alias("p"))  # as many as seeds
    order = packed.scalar()
    place = scored.select(mine.alias("m")).withColumn("o", order).select(F.size(F.filter("o", lambda x: x < F.col("m"))).alias("at"))
    counts = place.groupBy("at").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("at", "n"))).scalar()
    seen = packed.select(F.posexplode("p").alias("at", "m")).withColumn("c", counts)
    up_to = F.aggregate(F.filter("c", lambda x: x["at"] <= F.col("at")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return seen.select(F.col("m.k").alias(key), up_to.alias(name))


def fuse(keyword: DataFrame, vector: DataFrame, key: str, k: int, top: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (``keyword_rank``, ``vector_rank``)."""

    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (F.col(rank) + k), F.lit(0.0))

    both = keyword.join(vector, key, "full_outer")
    return both.withColumn("score", part("keyword_rank") + part("vector_rank")).orderBy(F.desc("score"), key).limit(top)


def hybrid_search(
    documents: DataFrame, text: str, query: str, vectors: DataFrame, query_vector: Column, top: int = 10,
    mode: str = "hybrid", rrf_k: int = P.rrf_k,
) -> DataFrame:
    """Keyword, vector or fused ranking of already filtered ``documents`` (``record_id`` and a text).

    The fusion is that of the whole lists. A row outside the first ``d`` of both scores less than ``2 / (rrf_k + d + 1)``, and
    ``top`` rows of either list score ``1 / (rrf_k + top)`` or more; with ``d = rrf_k + 2 * top`` the former is below the
    latter, so the rows of these two heads, with their true ranks in both lists, hold the answer. (Lists shorter than
    ``top`` are in the heads as a whole.)
    """
    from agorascope.operators.textual import fulltext_search

    words = fulltext_search(documents, F.col(text), query).select("record_id", F.round("score", 9).alias("score"))
    if mode == "keyword":
        return ranked(words, "record_id", "score", top, "keyword_rank").orderBy("keyword_rank")
    allowed = vectors.join(documents.select("record_id"), "record_id", "left_semi").withColumn("_q", query_vector)
    close = allowed.select("record_id", F.round(cosine(F.col("vector"), F.col("_q")), 9).alias("similarity")).filter(F.col("similarity").isNotNull())
    if mode == "vector":
        return ranked(close, "record_id", "similarity", top, "vector_rank").orderBy("vector_rank")
    words, close = stored(words, "keyword-scores"), stored(close, "vector-scores")  # an id and a number a row, read thrice
    depth = rrf_k + 2 * top
    heads = ranked(words, "record_id", "score", depth, "r").union(ranked(close, "record_id", "similarity", depth, "r"))
    seeds = stored(heads.select("record_id").distinct(), "heads")  # 2 * depth rows at most
    keyword = true_ranks(words, seeds, "record_id", "score", "keyword_rank")
    vector = true_ranks(close, seeds, "record_id", "similarity", "vector_rank")
    return fuse(keyword, vector, "record_id", rrf_k, top)


# ---- index state ----------------------------------------------------------------------------
def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def reconcile(rows: DataFrame, checkpoints: DataFrame, page: int) -> DataFrame:
    """The next ``page`` changed rows of each kind after its checkpoint, oldest first.

    Pages are cut on (updated_at, id) and the checkpoint keeps both, so equal times are not lost.
    """
    from agorascope.operators.paging import top_per_group

    few = F.broadcast(checkpoints.filter(F.col("kind").isin(*SEARCH_KINDS)))  # one row a kind, of five
    due = rows.join(few, "kind").filter(
        (F.col("updated_at") > F.col("last_synced_at"))
        | ((F.col("updated_at") == F.col("last_synced_at")) & (F.col("id") > F.col("last_id")))
    )
    return top_per_group(due, ["kind"], [F.col("updated_at"), F.col("id")], page)


def advance_checkpoints(checkpoints: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Checkpoints moved to the newest uploaded row of each kind."""
    top = uploaded.groupBy("kind").agg(F.max(F.struct("updated_at", "id")).alias("_m"), F.count(F.lit(1)).alias("uploaded"))
    return checkpoints.join(top, "kind", "left").select(
        "kind", F.coalesce("_m.updated_at", "last_synced_at").alias("last_synced_at"),
        F.coalesce("_m.id", "last_id").alias("last_id"), F.coalesce("uploaded", F.lit(0)).alias("uploaded"),
    )


def projection_diff(current: DataFrame, state: DataFrame) -> DataFrame:
    """What the index needs, per (kind, entity): insert, update, delete or nothing.

    ``current`` has the body's hash, ``state`` the hash last pushed and its status.
    """
    now = current.select("kind", "entity_id", F.col("content_hash").alias("_new"))
    old = state.select("kind", "entity_id", F.col("content_hash").alias("_old"), "status", "attempts")
    both = now.join(old, ["kind", "entity_id"], "full_outer")
    action = (
        F.when(F.col("_new").isNull(), F.when(F.col("status") == "deleted", "none").otherwise("delete"))
        .when(F.col("status").isNull() | (F.col("status") == "deleted"), "insert")
        .when(F.col("_new") != F.coalesce("_old", F.lit("")), "update")
        .when(F.col("status") == "synced", "none")
        .otherwise("update")
    )
    return both.select("kind", "entity_id", "_new", "_old", "status", "attempts", action.alias("action"))


def next_state(diff: DataFrame, failed: DataFrame) -> DataFrame:
    """State after the push; ``failed`` lists the (kind, entity_id) the index refused.

    Failures keep the old hash and count up; a success resets the count.
    """
    rows = diff.join(failed.select("kind", "entity_id").distinct().withColumn("_f", F.lit(True)), ["kind", "entity_id"], "left")
    tried, refused = F.col("action") != "none", F.col("_f").isNotNull()
    bad = tried & refused
    return rows.select(
        "kind", "entity_id", "action",
        F.when(bad, F.col("_old")).when(F.col("action") == "delete", F.col("_old"))
        .otherwise(F.coalesce("_new", "_old")).alias("content_hash"),
        F.when(bad, "failed").when(F.col("action") == "delete", "deleted")
        .when(tried, "synced").otherwise(F.col("status")).alias("status"),
        F.when(bad, F.coalesce("attempts", F.lit(0)) + 1).when(tried, F.lit(0))
        .otherwise(F.coalesce("attempts", F.lit(0))).alias("attempts"),
    )
