"""Queries on stories and themes, citations, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import TRACKING, canonical_url
from ..operators import citations, stories
from ..sources import adapters
from ..streaming import stories as stream_stories
from ..streaming import streams
from .registry import query

_URL = f"""u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS p FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_extract(p, '^([^?]*)', 1), '/+$', '') AS base, regexp_extract(p, '\\?(.*)$', 1) AS q FROM u),
 c AS (SELECT page_id, lower(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) AS host, substr(base, length(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1) AS path,
   list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^({'|'.join(TRACKING)})(=|$)'))) AS kept FROM b),
 canon AS (SELECT page_id, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM c)"""


@query(f"WITH {_URL} SELECT page_id, canonical_url FROM canon")
def url_canonical(spark, sf_dir):
    return adapters.table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical_url"))


def _items(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("item_id"), (F.col("page_id") % 2).cast("string").alias("source"), canonical_url(F.col("url")).alias("canonical_url"))


@query(f"WITH {_URL} SELECT CAST(page_id % 2 AS VARCHAR) AS source, canonical_url, min(page_id) AS item_id FROM canon GROUP BY 1, 2 HAVING min(page_id) % 3 <> 0")
def raw_item_dedupe(spark, sf_dir):
    items = stories.raw_items(_items(spark, sf_dir))
    known = items.where("item_id % 3 = 0")
    return stories.raw_items(_items(spark, sf_dir), known).select("source", "canonical_url", "item_id")


_STORIES = "s AS (SELECT doc_id AS story_id, ['TSLA','NVDA','AMD','AAPL','META'][CAST(doc_id % 5 AS INTEGER) + 1] AS ticker, text AS body, source AS outlet, 1700000000 + doc_id * 600 AS published FROM documents)"


def _groups(spark, sf_dir):
    s = adapters.stories(spark, sf_dir)
    return stories.exact(s.withColumn("key", F.sha2("body", 256)), F.col("key"))


@query(f"WITH {_STORIES} SELECT arg_min(story_id, published) AS canonical_id, count(*) AS members FROM s GROUP BY sha256(body) HAVING count(*) > 1")
def dedup_exact(spark, sf_dir):
    return _groups(spark, sf_dir).where("members > 1").select("canonical_id", "members")


@query(f"WITH {_STORIES} SELECT arg_min(story_id, published) AS canonical_id, count(DISTINCT outlet) AS outlets FROM s GROUP BY sha256(body)")
def story_outlet_counts(spark, sf_dir):
    return _groups(spark, sf_dir).select("canonical_id", "outlets")


@query(f"WITH {_STORIES} SELECT story_id, min(story_id) OVER (PARTITION BY sha256(body)) AS canonical_id FROM s")
def canonical_story(spark, sf_dir):
    s = adapters.stories(spark, sf_dir).withColumn("key", F.sha2("body", 256))
    return s.select("story_id", "key").join(stories.exact(s, F.col("key")), "key").select("story_id", "canonical_id")


_NEAR = """words AS (SELECT doc_id AS id, nullif(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), '') AS w FROM documents),
 classes AS (SELECT id, coalesce(min(id) OVER (PARTITION BY w), id) AS class, w FROM words WHERE w IS NOT NULL UNION ALL SELECT id, id, w FROM words WHERE w IS NULL),
 texts AS (SELECT id, string_split(w, ' ') AS l FROM classes WHERE id = class AND w IS NOT NULL AND len(string_split(w, ' ')) >= 5),
 grams AS (SELECT DISTINCT id, array_to_string(l[i : i + 4], ' ') AS g FROM (SELECT id, l, unnest(range(1, len(l) - 3)) AS i FROM texts)),
 sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
 common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
 near AS (SELECT a, b, 1 - CAST(c AS DOUBLE) / (p.n + q.n - c) AS distance FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 5 * c > 4 * (p.n + q.n - c)
   UNION ALL SELECT class, id, 0.0 FROM classes WHERE class <> id)"""


@query(f"WITH {_NEAR} SELECT a, b, distance FROM near")
def dedup_minhash(spark, sf_dir):
    s = adapters.stories(spark, sf_dir).withColumn("title", F.col("body"))
    return stories.near_pairs(s)


@query(f"""WITH RECURSIVE {_NEAR}, links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
  reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other)
  SELECT id, min(other) AS root FROM reach GROUP BY id""")
def story_components(spark, sf_dir):
    s = adapters.stories(spark, sf_dir).withColumn("title", F.col("body"))
    return stories.components(s.select(F.col("story_id").alias("id")), stories.near_pairs(s))


THRESHOLD = 0.30
_EMB = "e AS (SELECT vec_id, embedding, ['TSLA','NVDA','AMD','AAPL','META'][CAST(label % 5 AS INTEGER) + 1] AS ticker, 1700000000 + vec_id * 3600 AS published FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), lambda z: z[1] * z[2]))"


def _vectors(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("story_id"), "embedding", adapters.pick(adapters.TICKERS, F.col("label") % 5).alias("ticker"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 3600).alias("published_at"),
    )


@query(f"""WITH {_EMB} SELECT x.ticker, x.vec_id AS a, y.vec_id AS b, round({_DOT}, 6) AS similarity FROM e x JOIN e y ON x.ticker = y.ticker AND x.vec_id < y.vec_id AND y.published - x.published <= 36 * 3600
  WHERE {_DOT} >= {THRESHOLD}""")
def dedup_semantic_pairs(spark, sf_dir):
    return stories.semantic_pairs(_vectors(spark, sf_dir), THRESHOLD).withColumn("similarity", F.round("similarity", 6))


_FLOOR, _GAP = 0.1, 0.02


@query(f"""WITH RECURSIVE {_EMB}, v AS (SELECT vec_id AS id, embedding, ticker, CAST(CAST(make_timestamp(published * 1000000) AS DATE) AS VARCHAR) AS day FROM e),
  big AS (SELECT ticker, day FROM v GROUP BY 1, 2 HAVING count(*) >= 4),
  near AS (SELECT ticker, day, a, b, round(1 - s, 12) AS d FROM (SELECT x.ticker, x.day, x.id AS a, y.id AS b, {_DOT} AS s FROM v x JOIN v y ON x.ticker = y.ticker AND x.day = y.day AND x.id < y.id) JOIN big USING (ticker, day) WHERE s >= {_FLOOR}),
  core AS (SELECT ticker, day, id, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY ticker, day, id ORDER BY d) AS k FROM (SELECT ticker, day, a AS id, d FROM near UNION ALL SELECT ticker, day, b, d FROM near)) WHERE k = 2),
  edges AS (SELECT n.ticker, n.day, a, b, greatest(d, p.core, q.core) AS w FROM near n JOIN core p ON p.ticker = n.ticker AND p.day = n.day AND p.id = a JOIN core q ON q.ticker = n.ticker AND q.day = n.day AND q.id = b),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY w, a, b) AS r FROM edges),
  way AS (SELECT ticker, day, a AS x, b AS y, r FROM ranked UNION ALL SELECT ticker, day, b, a, r FROM ranked),
  reach AS (SELECT ticker, day, r, a AS node FROM ranked UNION SELECT t.ticker, t.day, t.r, way.y FROM reach t JOIN way ON way.ticker = t.ticker AND way.day = t.day AND way.x = t.node AND way.r < t.r),
  forest AS (SELECT k.* FROM ranked k LEFT JOIN reach t ON t.ticker = k.ticker AND t.day = k.day AND t.r = k.r AND t.node = k.b WHERE t.node IS NULL),
  steps AS (SELECT *, w - lag(w) OVER (PARTITION BY ticker, day ORDER BY w, a, b) AS step FROM forest),
  cuts AS (SELECT ticker, day, w AS cut FROM (SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY step DESC, w) AS k FROM steps WHERE step > {_GAP}) WHERE k = 1),
  kept AS (SELECT f.ticker, f.day, f.a, f.b FROM forest f LEFT JOIN cuts c USING (ticker, day) WHERE cut IS NULL OR w < cut),
  links AS (SELECT ticker, day, a AS x, b AS y FROM kept UNION ALL SELECT ticker, day, b, a FROM kept),
  comp AS (SELECT DISTINCT ticker, day, x AS id, x AS other FROM links UNION SELECT comp.ticker, comp.day, comp.id, links.y FROM comp JOIN links ON links.ticker = comp.ticker AND links.day = comp.day AND links.x = comp.other),
  roots AS (SELECT ticker, day, id, min(other) AS root FROM comp GROUP BY 1, 2, 3),
  sizes AS (SELECT ticker, day, root, row_number() OVER (PARTITION BY ticker, day ORDER BY count(*) DESC, root) - 1 AS theme FROM roots GROUP BY 1, 2, 3)
  SELECT v.ticker, v.day, v.id AS story_id, CAST(coalesce(theme, -1) AS INTEGER) AS theme FROM v LEFT JOIN roots ON roots.ticker = v.ticker AND roots.day = v.day AND roots.id = v.id
   LEFT JOIN sizes ON sizes.ticker = v.ticker AND sizes.day = v.day AND sizes.root = roots.root AND theme < 6""")
def theme_clusters(spark, sf_dir):
    """Density clusters of each ticker's day."""
    v = _vectors(spark, sf_dir).withColumn("day", F.to_date("published_at").cast("string"))
    return stories.density_clusters(v, _FLOOR, gap=_GAP)


@query(f"""WITH RECURSIVE {_EMB}, links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.ticker = y.ticker AND x.vec_id <> y.vec_id AND abs(y.published - x.published) <= 36 * 3600 WHERE {_DOT} >= {THRESHOLD}),
  reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other)
  SELECT id AS story_id, min(other) AS root FROM reach GROUP BY id""")
def stream_story_roots(spark, sf_dir):
    """Stories that come in several micro-batches in no order of time, and the components that they have grown to."""
    landed, store = streams.folder(spark, "stories-in"), streams.folder(spark, "stories")
    v = _vectors(spark, sf_dir)
    v.repartition(5, "story_id").write.parquet(landed)
    kept = stream_stories.StoryStore(spark, store, THRESHOLD)
    source = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    streams.run(source.writeStream.foreachBatch(kept.add), spark, "stories")
    return kept.roots()


@query(f"""WITH {_STORIES}, t AS (SELECT ticker, story_id // 50 AS theme_id, count(*) AS stories, count(DISTINCT outlet) AS outlets, max(published) AS latest FROM s GROUP BY 1, 2),
  c AS (SELECT *, stories + 2 * outlets - (max(latest) OVER (PARTITION BY ticker) - latest) / 3600.0 / 10 AS salience FROM t)
  SELECT ticker, theme_id, stories, outlets, round(CAST(salience AS DOUBLE), 6) AS salience, CAST(row_number() OVER (PARTITION BY ticker ORDER BY round(CAST(salience AS DOUBLE), 9) DESC, theme_id) AS INTEGER) AS salience_rank FROM c""")
def theme_salience(spark, sf_dir):
    s = adapters.stories(spark, sf_dir).withColumn("theme_id", F.expr("story_id div 50"))
    themes = s.groupBy("ticker", "theme_id").agg(F.count("*").alias("stories"), F.count_distinct("outlet").alias("outlets"), F.max("published_at").alias("latest"))
    return stories.salience(themes).select("ticker", "theme_id", "stories", "outlets", F.round("salience", 6).alias("salience"), "salience_rank")


@query(f"""WITH {_EMB}, d AS (SELECT *, published // 86400 AS run FROM e), p AS (SELECT x.ticker, x.vec_id AS theme_id, y.vec_id AS previous_id, {_DOT} AS similarity FROM d x JOIN d y ON x.ticker = y.ticker AND x.run = y.run + 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY ticker, theme_id ORDER BY similarity DESC, previous_id) AS k FROM p)
  SELECT ticker, theme_id, previous_id, round(similarity, 6) AS similarity FROM r WHERE k = 1 AND similarity >= 0.2""")
def theme_stability(spark, sf_dir):
    """Each day's themes against those of the day before."""
    v = _vectors(spark, sf_dir).withColumnsRenamed({"story_id": "theme_id", "embedding": "centroid"}).withColumn("run", F.floor(F.unix_timestamp("published_at") / 86400))
    return stories.best_previous(v, 0.2).withColumn("similarity", F.round("similarity", 6))


_RUNS = f"""{_EMB}, d AS (SELECT ticker, vec_id, embedding, published // 86400 AS run FROM e),
  p AS (SELECT x.ticker, x.run, x.vec_id AS theme_id, y.vec_id AS previous_id, {_DOT} AS similarity FROM d x JOIN d y ON x.ticker = y.ticker AND x.run = y.run + 1 WHERE {_DOT} >= 0.2),
  t AS (SELECT ticker, run, theme_id, row_number() OVER (PARTITION BY ticker, run ORDER BY theme_id) AS k FROM (SELECT DISTINCT ticker, run, theme_id FROM p)),
  n AS (SELECT ticker, run, max(k) AS k FROM t GROUP BY 1, 2),
  o AS (SELECT ticker, run, theme_id, previous_id, CAST(round(similarity * 1e9) AS BIGINT) AS g FROM p UNION ALL SELECT DISTINCT ticker, run, theme_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM p),
  s AS (SELECT ticker, run, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS picked, CAST(0 AS BIGINT) AS total FROM n
    UNION ALL SELECT s.ticker, s.run, t.k, list_append(s.picked, o.previous_id), s.total + o.g FROM s JOIN t ON t.ticker = s.ticker AND t.run = s.run AND t.k = s.k + 1
      JOIN o ON o.ticker = t.ticker AND o.run = t.run AND o.theme_id = t.theme_id AND (o.previous_id IS NULL OR NOT list_contains(s.picked, o.previous_id))),
  best AS (SELECT ticker, run, arg_max(picked, total) AS picked FROM s JOIN n USING (ticker, run, k) GROUP BY 1, 2),
  one AS (SELECT t.ticker, t.run, t.theme_id, best.picked[t.k] AS previous_id FROM best JOIN t USING (ticker, run) WHERE best.picked[t.k] IS NOT NULL)"""


def _run_themes(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumnsRenamed({"story_id": "theme_id", "embedding": "centroid"})
    return v.select("ticker", F.floor(F.unix_timestamp("published_at") / 86400).alias("run"), "theme_id", "centroid")


@query(f"WITH RECURSIVE {_RUNS} SELECT one.ticker, one.theme_id, one.previous_id, round(similarity, 6) AS similarity FROM one JOIN p ON p.theme_id = one.theme_id AND p.previous_id = one.previous_id")
def theme_assignment(spark, sf_dir):
    """Each day's themes and those of the day before, one to one, with the largest total similarity."""
    pairs = stories.one_to_one(stories.similar_previous(_run_themes(spark, sf_dir), 0.2))
    return pairs.select("ticker", "theme_id", "previous_id", F.round("similarity", 6).alias("similarity"))


_IDENTITY = f"""WITH RECURSIVE {_RUNS}, chain AS (SELECT ticker, run, vec_id AS theme_id, vec_id AS node FROM d UNION ALL SELECT chain.ticker, chain.run, chain.theme_id, one.previous_id FROM chain JOIN one ON one.theme_id = chain.node)
  SELECT ticker, run, theme_id, arg_min(node, place) AS identity FROM (SELECT chain.*, d.run AS place FROM chain JOIN d ON d.vec_id = chain.node) GROUP BY 1, 2, 3"""


@query(_IDENTITY)
def theme_identities(spark, sf_dir):
    return stories.identities(_run_themes(spark, sf_dir), 0.2)


@query(_IDENTITY)
def stream_theme_identities(spark, sf_dir):
    """The same identities, kept over micro-batches of some days each."""
    landed, store = streams.folder(spark, "themes-in"), streams.folder(spark, "themes")
    t = _run_themes(spark, sf_dir)
    # files in the order of their days, as runs come
    t.repartitionByRange(4, "run").sortWithinPartitions("run").write.parquet(landed)
    kept = stream_stories.ThemeStore(spark, store, 0.2)
    files = sorted(row.file for row in spark.read.parquet(landed).select(F.input_file_name().alias("file")).distinct().collect())
    for number, file in enumerate(files):
        kept.add(spark.read.schema(t.schema).parquet(file), number)
    return kept.identities()


@query(f"""WITH {_STORIES}, t AS (SELECT story_id // 20 AS theme_id, sha256(string_agg(CAST(story_id AS VARCHAR), ',' ORDER BY CAST(story_id AS VARCHAR))) AS content_hash FROM s GROUP BY 1)
  SELECT theme_id, content_hash FROM t WHERE theme_id % 2 = 1""")
def summary_cache_misses(spark, sf_dir):
    s = adapters.stories(spark, sf_dir).withColumn("theme_id", F.expr("story_id div 20"))
    themes = s.groupBy("theme_id").agg(stories.content_hash(F.collect_list("story_id")).alias("content_hash"))
    return stories.changed_only(themes, themes.where("theme_id % 2 = 0"))


def _summaries(spark, sf_dir):
    """Authored summaries over story ids, by event id: good ones and one for each way to break the rules."""
    e, k = adapters.table(spark, sf_dir, "events"), F.col("event_id") % 7
    sid = F.col("event_id").cast("string")

    def sentence(text, *ids):
        return F.struct(F.lit(text).alias("text"), F.array(*ids).cast("array<string>").alias("citation_ids"))

    two = F.array(sentence("First fact.", sid), sentence("Second fact.", F.concat(sid, F.lit("b"))))
    return e.select(
        "event_id",
        F.when(k == 1, F.lit("one two three four five six seven eight nine")).when(k == 2, F.lit("")).otherwise(F.lit("Short label")).alias("label"),
        F.when(k == 3, F.array(sentence("Only one.", sid)))
        .when(k == 4, F.array(sentence("  ", sid), sentence("Second fact.", sid)))
        .when(k == 5, F.array(sentence("First fact.", sid), sentence("Uncited.")))
        .when(k == 6, F.array(sentence("First fact.", sid), sentence("Elsewhere.", F.lit("foreign")))).otherwise(two).alias("sentences"),
        F.array(sid, F.concat(sid, F.lit("b"))).alias("members"),
    )


_VIOLATION = "CASE event_id % 7 WHEN 1 THEN 'label_length' WHEN 2 THEN 'label_length' WHEN 3 THEN 'sentence_count' WHEN 4 THEN 'blank_sentence' WHEN 5 THEN 'no_citation' WHEN 6 THEN 'unresolved_citation' ELSE '' END"


@query(f"SELECT event_id, {_VIOLATION} AS violations FROM events")
def summary_schema_check(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    return s.select("event_id", F.array_join(citations.violations(F.col("label"), F.col("sentences"), F.col("members")), ",").alias("violations"))


@query("SELECT event_id, 'foreign' AS citation_id FROM events WHERE event_id % 7 = 6")
def citation_check(spark, sf_dir):
    s = _summaries(spark, sf_dir).select("event_id", "members", F.explode("sentences").alias("s"))
    cited = s.select("event_id", F.explode("s.citation_ids").alias("citation_id"))
    members = s.select("event_id", F.explode("members").alias("citation_id")).distinct()
    return cited.join(members, ["event_id", "citation_id"], "left_anti").distinct()


@query("""WITH s AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'accepted' WHEN event_id % 2 = 0 THEN 'accepted_after_retry' ELSE 'degraded' END AS status FROM events) SELECT status, count(*) AS themes FROM s GROUP BY status""")
def guardrail_status(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    ok = citations.acceptable(F.col("label"), F.col("sentences"), F.col("members"))
    return s.select(citations.status(ok, F.col("event_id") % 2 == 0).alias("status")).groupBy("status").agg(F.count("*").alias("themes"))


def _themes(spark, sf_dir):
    s = adapters.stories(spark, sf_dir).withColumn("theme_id", F.expr("story_id div 5"))
    story = F.struct(F.col("story_id").alias("order"), F.col("story_id").cast("string").alias("id"), "title", F.col("body").alias("description"), "outlet", F.date_format("published_at", "yyyy-MM-dd").alias("published_at"))
    return s.groupBy("theme_id").agg(F.array_sort(F.collect_list(story)).alias("stories")).withColumn("ticker", F.lit("TSLA"))


@query("""WITH t AS (SELECT doc_id // 5 AS theme_id, string_agg('- id: ' || doc_id || chr(10) || '  title: ' || text || chr(10) || '  description: ' || text || chr(10) || '  outlet: ' || source || chr(10) || '  time: ' ||
    strftime(make_timestamp((1700000000 + doc_id * 600) * 1000000), '%Y-%m-%d'), chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY 1)
  SELECT theme_id, sha256('Ticker: TSLA' || chr(10) || 'Member stories:' || chr(10) || body) AS prompt_sha256 FROM t""")
def prompt_serialization(spark, sf_dir):
    t = _themes(spark, sf_dir)
    return t.select("theme_id", F.sha2(citations.prompt(F.col("ticker"), F.lit(None).cast("string"), F.col("stories")), 256).alias("prompt_sha256"))


@query("""WITH r AS (SELECT doc_id // 5 AS theme_id, doc_id, source, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) - 1 AS sentence FROM documents)
  SELECT theme_id, CAST(sentence AS INTEGER) AS sentence, CAST(doc_id AS VARCHAR) AS id, source AS outlet FROM r WHERE sentence < 4""")
def resolved_citations(spark, sf_dir):
    out = citations.resolved(citations.summarize(_themes(spark, sf_dir)))
    return out.select("theme_id", "sentence", "id", "outlet")
