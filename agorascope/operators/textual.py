"""Keyword search, phrase frequencies, shapes of sentences, keyword topics and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorascope.functions.text import fingerprint, ngrams, tail, tokens
from agorascope.operators.rollups import n_rows
from agorascope.operators.set_pairs import in_cell
from agorascope.params import P
from agorascope.session import stored

# Function words kept by the analyser's stop list and by sentence shapes (our own list).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "was", "with",
)


LOW_JACCARD = 0.5  # below it stories are compared in cells, from it on through shared rare words
CELL_STORIES = 1024  # and as many candidates


def query_terms(text: str) -> list[str]:
    """Analysed query: distinct lower-case words outside the stop list, in order."""
    import regex

    seen = dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", text.lower()))
    return [w for w in seen if w not in STOP_WORDS]


def occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def fulltext_search(documents: DataFrame, text: Column, query: str, k1: float = P.bm25_k1, b: float = P.bm25_b) -> DataFrame:
    """Documents holding every query term, with their BM25 ``score`` (no stemming).

    Corpus statistics are one aggregate row, read as a scalar subquery. Terms of the query are
    a few constants, so there is no postings join.
    """
    terms = query_terms(query)
    if not terms:
        return documents.withColumn("score", F.lit(None).cast("double")).filter(F.lit(False))
    words = tokens(text)
    counted = documents.withColumn("_w", words).withColumn("_len", F.size("_w"))
    for i, term in enumerate(terms):
        counted = counted.withColumn(f"_tf{i}", occurrences("_w", term))
    counted = counted.drop("_w")
    stats = counted.agg(F.struct(
        n_rows().alias("n"), F.avg("_len").alias("avg_len"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    ).alias("s")).scalar()
    hits = counted
    for i in range(len(terms)):
        hits = hits.filter(F.col(f"_tf{i}") > 0)
    hits = hits.withColumn("_s", stats)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_s.df{i}")
        idf = F.log(F.lit(1.0) + (F.col("_s.n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_s.avg_len")))
    return hits.withColumn("score", score).drop("_s", "_len", *[f"_tf{i}" for i in range(len(terms))])


def _sized(n: int) -> Column:
    return F.transform(ngrams(F.col("_w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("ngram")))


def ngram_counts(texts: DataFrame, n_min: int, n_max: int) -> DataFrame:
    """Recent and baseline counts of each n-gram.

    ``texts`` has ``text`` and how often it occurs in either window (``recent``, ``baseline``):
    copies of a text are counted before it is cut into words.
    """
    w = tokens(F.col("text"))
    parts = [_sized(n) for n in range(n_min, n_max + 1)]
    exploded = texts.filter((F.col("recent") > 0) | (F.col("baseline") > 0)).select(
        w.alias("_w"), "recent", "baseline"
    ).select("recent", "baseline", F.inline(F.concat(*parts) if len(parts) > 1 else parts[0]))
    return exploded.groupBy("n", "ngram").agg(F.sum("recent").alias("recent_n"), F.sum("baseline").alias("baseline_n"))


def ngram_totals(texts: DataFrame, n_min: int, n_max: int) -> DataFrame:
    """Number of n-grams of each size in either window, from word counts alone: nothing is exploded."""
    sized = texts.select("recent", "baseline", F.size(tokens(F.col("text"))).alias("_k"))

    def total(weight: str, n: int) -> Column:
        return F.sum(F.greatest(F.col("_k") - (n - 1), F.lit(0)) * F.col(weight))

    rows = F.array(*[
        F.struct(F.lit(n).alias("n"), total("recent", n).alias("_tr"), total("baseline", n).alias("_tb")) for n in range(n_min, n_max + 1)
    ])
    return sized.agg(rows.alias("_r")).select(F.inline("_r"))


def ngram_delta(
    texts: DataFrame, n_min: int = 1, n_max: int = 3, min_delta: float = P.phrase_min_delta,
    min_count: int = P.phrase_min_count,
) -> DataFrame:
    """N-grams whose share of the recent window exceeds their baseline share by ``min_delta``."""
    every = ngram_counts(texts, n_min, n_max)
    # one row per n, from the same counted shuffle: texts are joined and cut into words once
    totals = every.groupBy("n").agg(F.sum("recent_n").alias("_tr"), F.sum("baseline_n").alias("_tb"))
    share = every.filter(F.col("recent_n") >= min_count).join(F.broadcast(totals), "n")
    delta = F.col("recent_n") / F.col("_tr") - F.coalesce(F.col("baseline_n") / F.nullif("_tb", F.lit(0)), F.lit(0.0))
    return (
        share.withColumn("delta", delta)
        .filter(F.col("delta") >= min_delta)
        .select("n", "ngram", "recent_n", "baseline_n", "delta")
    )


def phrase_holders(documents: DataFrame, phrases: DataFrame, n: int) -> DataFrame:
    """(value, doc_id): the documents that hold each phrase of ``n`` words (column ``value``).

    Words are a column of their own: within ``ngrams`` the text would be cut into words again for each of its runs.
    """
    cut = documents.select("doc_id", tokens(F.col("text")).alias("_w"))
    return cut.select("doc_id", F.explode(F.array_distinct(ngrams(F.col("_w"), n))).alias("value")).join(phrases, "value")


def ngram_vs_source(output: DataFrame, source: DataFrame, n: int = 1, min_ratio: float = 2.0, min_count: int = 3) -> DataFrame:
    """N-grams of the output that are over-used against the sources it drew on.

    Both inputs are ``texts`` frames (see ``ngram_counts``); words common in the sources pass.
    """
    ours = ngram_counts(output, n, n).select("ngram", F.col("recent_n").alias("output_n"))
    theirs = ngram_counts(source, n, n).select("ngram", F.col("recent_n").alias("source_n"))
    total_out, total_src = (ngram_totals(t, n, n).select("_tr").scalar() for t in (output, source))
    both = ours.filter(F.col("output_n") >= min_count).join(theirs, "ngram", "left")
    ratio = (F.col("output_n") / total_out) / ((F.coalesce("source_n", F.lit(0)) + 1) / total_src)
    return both.withColumn("ratio", ratio).filter(F.col("ratio") >= min_ratio)


def shapes(stories: DataFrame, length: int = P.fingerprint_length, words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Opening, closing and headline fingerprints with their counts and share."""
    w, h = tokens(F.col("content")), tokens(F.col("headline"))
    keep = list(words)
    chosen = {"opening": F.col("_w"), "closing": tail(F.col("_w"), length), "headline": F.col("_h")}
    parts = F.array(*[
        F.struct(F.lit(part).alias("part"), fingerprint(c, keep, length).alias("fingerprint")) for part, c in chosen.items()
    ])
    rows = stories.select(w.alias("_w"), h.alias("_h")).select(F.inline(parts))
    counts = rows.groupBy("part", "fingerprint").agg(n_rows().alias("n"))
    totals = counts.groupBy("part").agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(totals), "part").select("part", "fingerprint", "n", (F.col("n") / F.col("_t")).alias("share"))


def saturated_candidates(stories: DataFrame, run: DataFrame, min_jaccard: float, days: int = 14) -> DataFrame:
    """Every candidate of this ``run`` (column ``id``) against the active stories of its topic, by word-set Jaccard.

    Stories count from ``days`` before the candidate up to it. Below ``LOW_JACCARD`` stories that share any few words are near,
    nearly every pair of a topic and period is an answer, and each is compared once, in cells of about ``CELL_STORIES`` stories and as many
    candidates with their words, whose shared words are counted by a matrix product: what is shuffled is stories, not pairs or the words
    they share. From there on a set-similarity join: words are ordered by rarity among
    all live stories, and two sets of n words that reach ``min_jaccard`` share one of their first
    ``n - ceil(min_jaccard * n) + 1``. Only stories that share such a word, lie in the same or the preceding period of
    ``days``, and have sizes that allow the similarity are compared. ``min_jaccard`` is above zero.
    """
    if min_jaccard <= 0:
        raise ValueError("min_jaccard must be positive: stories without a common word are never compared")
    least = F.lit(min_jaccard - 5e-7)  # scores are rounded to six digits
    words = F.array_distinct(tokens(F.col("content")))
    live = stories.filter("active AND topic_id IS NOT NULL").select("topic_id", "id", "generated_at", words.alias("_w")).filter(F.size("_w") > 0)
    length = 86_400 * days
    if min_jaccard < LOW_JACCARD:
        flagged = live.join(run.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
        return _saturated_in_cells(stored(flagged, "story-words"), min_jaccard, days)
    live = stored(live, "story-words")
    each = live.select("topic_id", "id", "generated_at", F.size("_w").alias("_n"), F.explode("_w").alias("word"))
    rarity = each.groupBy("word").agg(n_rows().alias("_df"))
    ordered = each.join(rarity, "word").groupBy("topic_id", "id", "generated_at", "_n").agg(F.sort_array(F.collect_list(F.struct("_df", "word"))).alias("_o"))
    first = F.slice("_o", F.lit(1), (F.col("_n") - F.ceil(least * F.col("_n")) + 1).cast("int"))
    period = F.floor(F.unix_seconds("generated_at") / length)
    prefix = ordered.select("topic_id", "id", "generated_at", "_n", period.alias("_b"), F.explode(F.transform(first, lambda x: x["word"])).alias("word"))
    prefix = stored(prefix, "story-prefixes")
    asked = prefix.join(run.select("id").distinct(), "id", "left_semi").select(
        "topic_id", "word", F.col("id").alias("candidate_id"), F.col("generated_at").alias("_g"), F.col("_n").alias("_m"),
        F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_b"),
    )
    recent, sized = _comparable(least, days)
    met = prefix.join(asked, ["topic_id", "word", "_b"]).filter((F.col("id") != F.col("candidate_id")) & recent & sized)
    pairs = met.select("topic_id", "candidate_id", "id").distinct()
    both = pairs.join(live.select("id", "_w"), "id").join(live.select(F.col("id").alias("candidate_id"), F.col("_w").alias("_c")), "candidate_id")
    return _scored_pairs(both, min_jaccard)


def _comparable(least: Column, days: int) -> tuple[Column, Column]:
    """Whether a story (generated_at, _n words) lies in the window of a candidate (_g, _m words), and whether the sizes allow the similarity."""
    recent = (F.col("generated_at") <= F.col("_g")) & (F.col("generated_at") > F.col("_g") - F.make_dt_interval(days=F.lit(days)))
    return recent, (F.col("_n") >= least * F.col("_m")) & (F.col("_m") >= least * F.col("_n"))


def _scored_pairs(both: DataFrame, min_jaccard: float) -> DataFrame:
    common = F.size(F.array_intersect("_w", "_c"))
    return _near(both.select("topic_id", "candidate_id", "id", common.alias("_i"), (F.size("_w") + F.size("_c")).alias("_s")), min_jaccard)


def _near(counted: DataFrame, min_jaccard: float) -> DataFrame:
    scored = counted.select("topic_id", "candidate_id", "id", F.round(F.col("_i") / (F.col("_s") - F.col("_i")), 6).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= min_jaccard)


def _saturated_in_cells(live: DataFrame, min_jaccard: float, days: int) -> DataFrame:
    """Stories of a topic and period are dealt over cells of bounded size, the candidates of a period (true in ``_asked``) over blocks;
    each block meets the cells of its period and of the one before.
    """
    rows = live.filter("id IS NOT NULL").withColumn("_b", F.floor(F.unix_seconds("generated_at") / (86_400 * days)))
    rows = rows.select("topic_id", "id", "_asked", "_b", F.unix_micros("generated_at").alias("_t"), "_w")
    sizes = (n_rows(), "_cells"), (F.count("_asked"), "_blocks")
    cells = rows.groupBy("topic_id", "_b").agg(*[F.ceil(n / CELL_STORIES).cast("int").alias(x) for n, x in sizes])
    cells = stored(cells, "story-cells")
    blocks = cells.filter("_blocks > 0").select("topic_id", F.col("_b").alias("_p"), "_blocks")
    cells = cells.drop("_blocks")
    dealt = rows.join(cells, ["topic_id", "_b"]).withColumn("_cell", F.pmod(F.xxhash64("id"), F.col("_cells")).cast("int"))
    dealt = dealt.withColumn("_p", F.explode(F.array("_b", F.col("_b") + 1))).join(blocks, ["topic_id", "_p"])
    dealt = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_cells", "_blocks", "_asked")
    asked = rows.filter("_asked").drop("_asked").withColumnsRenamed({"id": "candidate_id", "_b": "_p"}).join(blocks, ["topic_id", "_p"])
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("candidate_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    asked = asked.withColumn("_b", F.explode(F.array("_p", F.col("_p") - 1))).join(cells, ["topic_id", "_b"])
    asked = asked.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).drop("_cells")
    asked = asked.select([F.col(c).alias(c) for c in asked.columns])  # columns of its own, not those of the stories
    key = ["topic_id", "_b", "_p", "_cell", "_block"]
    kinds = dict(live.dtypes)
    met = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        in_cell(min_jaccard - 1e-6, 86_400_000_000 * days),  # scores are rounded to six digits
        f"topic_id {kinds['topic_id']}, candidate_id {kinds['id']}, id {kinds['id']}, _i long, _s long",
    )
    return _near(met, min_jaccard)


def assign_topics_keyword(texts: DataFrame, topics: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(record, topic) where a keyword of the topic occurs as a word; confidence NULL.

    With ``owners`` (record_id, text_id) the ids of ``texts`` are text ids: each text is cut into words once and
    its topics go to all records that have it.
    """
    keywords = topics.select(F.col("id").alias("topic_id"), F.explode("keywords").alias("word"))
    words = texts.select("record_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    found = words.join(keywords, "word").select("record_id", "topic_id").distinct()
    if owners is not None:
        found = owners.join(found.withColumnRenamed("record_id", "text_id"), "text_id")
    return found.select(
        "record_id", "topic_id", F.lit("keyword").alias("method"), F.lit(None).cast("double").alias("confidence")
    )


class NameTrie:
    """Dictionary names by their words; ``found`` reads a text once, however many names there are."""

    def __init__(self, names: list[tuple[int, str]]):
        import regex

        self.words = regex.compile(r"[\p{L}\p{N}]+").finditer
        self.root: dict = {}
        for entity, name in dict.fromkeys(names):
            low = name.lower()
            spans = [m.span() for m in self.words(low)]
            if spans:
                node = self.root
                for a, b in spans:
                    node = node.setdefault(low[a:b], {})
                node.setdefault(None, []).append((entity, low, spans[0][0]))

    def found(self, text: str, longest: bool = False) -> list[tuple[int, int, int]]:
        """(entity, start, end) in order of start: whole words only; occurrences of one name do not overlap.

        With ``longest``, only the longest name at a place counts, and no name inside it.
        """
        spans = [m.span() for m in self.words(text)]
        low = [text[a:b].lower() for a, b in spans]
        out, ends, free = [], {}, 0
        for i, (at, _) in enumerate(spans):
            node, hits = self.root, []
            for j in range(i, len(low)):
                node = node.get(low[j])
                if node is None:
                    break
                for entity, name, lead in node.get(None, ()):
                    start = at - lead
                    end = start + len(name)
                    if start >= max(0, ends.get((entity, name), 0)) and text[start:end].lower() == name and not self._word(text, start - 1) and not self._word(text, end):
                        hits.append((entity, start, end, name))
            if longest:
                hits = [h for h in hits if h[1] >= free]
                hits = [h for h in hits if h[2] - h[1] == max(x[2] - x[1] for x in hits)]
                free = max([free, *(h[2] for h in hits)])
            for entity, start, end, name in hits:
                ends[entity, name] = end
                out.append((entity, start, end))
        return out

    def _word(self, text: str, at: int) -> bool:
        return 0 <= at < len(text) and next(self.words(text[at]), None) is not None


def extract_mentions(texts: DataFrame, dictionary: DataFrame, longest: bool = False, most_names: int = P.trie_names) -> DataFrame:
    """Every occurrence of a dictionary name in a text, as whole words, with character offsets.

    A dictionary of up to ``most_names`` names goes to each task as a trie of words, and each text is read once, in time
    linear in its words and hits. A larger one is joined on the names' first words instead; the rows are the same.
    ``longest`` keeps only the longest of overlapping names (tries only).
    """
    names = dictionary.select("entity_id", "name").filter("entity_id IS NOT NULL AND name IS NOT NULL")
    if names.limit(most_names + 1).count() > most_names:
        if longest:
            raise ValueError("longest matches need a dictionary of at most most_names names")
        return _mentions_by_join(texts, names)
    shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in names.collect()])

    def scan(batches):
        import pyarrow as pa

        trie = NameTrie(shared.value)
        for batch in batches:
            rows = [(r, *m) for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in trie.found(text or "", longest)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, pa_kinds)], ["record_id", "entity_id", "start_offset", "end_offset"])

    kinds = [texts.schema["record_id"].dataType, dictionary.schema["entity_id"].dataType, T.IntegerType(), T.IntegerType()]
    from pyspark.sql.pandas.types import to_arrow_type

    pa_kinds = [to_arrow_type(k) for k in kinds]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(["record_id", "entity_id", "start_offset", "end_offset"], kinds)])
    return texts.select("record_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def _mentions_by_join(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same by joins alone: candidates come from an equi-join on the name's first word; offsets are computed only for
    texts that have a hit, in characters of the text as it stands.
    """
    names = dictionary.select(
        "entity_id", F.lower("name").alias("_name"), F.get(tokens(F.col("name")), 0).alias("_first")
    )
    words = texts.select("record_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("_first"))
    hits = words.join(names, "_first").select("record_id", "entity_id", "_name")
    word = r"[\p{L}\p{N}]"
    pattern = F.concat(F.lit(f"(?iu)(?<!{word})\\Q"), F.col("_name"), F.lit(f"\\E(?!{word})"))
    pieces = hits.join(texts, "record_id").select(
        "record_id", "entity_id", F.length("_name").alias("_len"), F.split("text", pattern, F.lit(-1)).alias("_p")
    ).filter(F.size("_p") > 1)

    def offset(i: Column) -> Column:
        before = F.aggregate(F.slice("_p", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))
        return before + (i - 1) * F.col("_len")

    starts = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), offset)
    return pieces.select("record_id", "entity_id", "_len", F.explode(starts).alias("start_offset")).select(
        "record_id", "entity_id", "start_offset", (F.col("start_offset") + F.col("_len")).alias("end_offset")
    )
