"""Product identity, search and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwell.functions import text
from tagwell.operators import history, relational
from tagwell.plans.prices import query
from tagwell.plans.tables import read
from tagwell.sources import html_links as links
from tagwell.streaming.rules import ALLOWED, rolling_totals

SOUGHT, NEAREST = "small red bolt", 3
CHECK = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CAST(substr(d, i, 1) AS INTEGER) * CASE WHEN (length(d) - i) % 2 = 0 THEN 1 ELSE 3 END))"
GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(norm, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 12, '0') || '0' AS d FROM part), c AS (SELECT p_partkey, left(d, 12) || CAST((10 - {CHECK} % 10) % 10 AS VARCHAR) AS d FROM b)
SELECT p_partkey, d AS gtin, {CHECK} % 10 = 0 AS valid, CASE WHEN right(d, 1) = '0' THEN 'gtin' ELSE 'retailer_item' END AS with_last_digit_0 FROM c""")
def gtin_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GTIN made from each part's key, its check, and the kind of the code with 0 as last digit."""
    body = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    made = read(spark, sf_dir, "part").select("p_partkey", F.concat(body, text.check_digit(body)).alias("gtin"), body.alias("body"))
    return made.select("p_partkey", "gtin", text.is_gtin(F.col("gtin")).alias("valid"), text.identifier_kind(F.concat("body", F.lit("0"))).alias("with_last_digit_0"))


@query(f"SELECT p_partkey, {NORM.format('p_name')} AS name, {NORM.format('p_brand')} AS brand FROM part")
def text_normalize_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.ascii_search_text(F.col("p_name")).alias("name"), text.ascii_search_text(F.col("p_brand")).alias("brand"))


SIMILAR = f"""q AS (SELECT {GRAMS} AS q FROM (SELECT '{SOUGHT}' AS norm)), g AS (SELECT p_partkey, norm, {GRAMS} AS g FROM (SELECT p_partkey, {NORM.format('p_name')} AS norm FROM part)),
sim AS (SELECT p_partkey, norm, length(list_intersect(g, q)) / length(list_distinct(list_concat(g, q))) AS similarity FROM g, q)"""


@query(f"WITH {SIMILAR} SELECT p_partkey, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.3")
def trigram_similarity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose name is like the sought one by shared trigrams; distinct names are compared once."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = part.select("p_name").distinct().withColumn("similarity", text.trigram_similarity(F.col("p_name"), F.lit(SOUGHT))).where("similarity >= 0.3")
    return part.join(names, "p_name").select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {SIMILAR} SELECT p_partkey, round(CASE WHEN norm = 'red bolt' THEN 100 WHEN starts_with(norm, 'red') THEN 90 WHEN contains(norm, 'bolt') THEN 50 ELSE 20 + similarity END, 6) AS rank FROM sim
WHERE norm = 'red bolt' OR starts_with(norm, 'red') OR contains(norm, 'bolt') OR similarity >= 0.3""")
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by how they meet a search: the whole name, its beginning, a part of it, or likeness."""
    name = text.ascii_search_text(F.col("p_name"))
    similarity = text.trigram_similarity(F.col("p_name"), F.lit(SOUGHT))
    rank = F.when(name == "red bolt", 100.0).when(name.startswith("red"), 90.0).when(name.contains("bolt"), 50.0).when(similarity >= 0.3, 20 + similarity)
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = part.select("p_name").distinct().withColumn("rank", F.round(rank, 6)).where("rank IS NOT NULL")
    return part.join(names, "p_name").select("p_partkey", "rank")


@query(f"""WITH t AS (SELECT DISTINCT p_brand, p_name, list_distinct(list_filter(string_split({NORM.format('p_name')}, ' '), lambda w: w <> '')) AS t FROM part)
SELECT a.p_brand AS brand, a.p_name AS name, b.p_name AS other, round(length(list_intersect(a.t, b.t)) / length(list_distinct(list_concat(a.t, b.t))), 6) AS similarity
FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE length(list_intersect(a.t, b.t)) * 3 >= length(list_distinct(list_concat(a.t, b.t)))""")
def token_jaccard_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one brand that share a third of their words; only names with a common word meet."""
    names = read(spark, sf_dir, "part").select("p_brand", "p_name").distinct().withColumn("t", text.tokens(F.col("p_name")))
    words = names.withColumn("word", F.explode("t"))
    a, b = words.alias("a"), words.alias("b")
    met = a.join(b, F.expr("a.p_brand = b.p_brand AND a.word = b.word AND a.p_name < b.p_name"))
    pairs = met.groupBy(F.col("a.p_brand").alias("brand"), F.col("a.p_name").alias("name"), F.col("b.p_name").alias("other"), F.size("a.t").alias("n"), F.size("b.t").alias("m")).agg(F.count(F.lit(1)).alias("common"))
    return pairs.where("3 * common >= n + m - common").select("brand", "name", "other", F.round(F.col("common") / (F.col("n") + F.col("m") - F.col("common")), 6).alias("similarity"))


@query(f"""WITH pairs AS (SELECT a.p_partkey AS item, b.p_partkey AS candidate, min(CASE WHEN a.p_name = b.p_name THEN 0 ELSE 1 END) AS priority FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY priority, candidate) AS place FROM pairs) SELECT item, candidate, priority, place FROM ranked WHERE place <= {NEAREST}""")
def blocked_topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each product the first candidates of its block (brand and size), equal names before others.

    No two rows of a block meet: a block's first ids of each name, and the first of these, hold all candidates of all its products.
    """
    block, name = ["p_brand", "p_size"], ["p_brand", "p_size", "p_name"]
    part = read(spark, sf_dir, "part").select("p_partkey", *name)
    first = relational.ranked(part, name, [F.col("p_partkey")], "place").where(F.col("place") <= NEAREST + 1)
    same = first.groupBy(*name).agg(F.sort_array(F.collect_list("p_partkey")).alias("same"))
    listed = relational.ranked(first.where(F.col("place") <= NEAREST).drop("place"), block, [F.col("p_partkey")], "place").where(F.col("place") <= 2 * NEAREST)
    others = listed.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("others"))
    rows = part.join(same, name).join(others, block)
    equal = F.transform(F.filter("same", lambda x: x != F.col("p_partkey")), lambda x: F.struct(x.alias("candidate"), F.lit(0).alias("priority")))
    other = F.transform(F.filter("others", lambda x: x["p_name"] != F.col("p_name")), lambda x: F.struct(x["p_partkey"].alias("candidate"), F.lit(1).alias("priority")))
    found = F.posexplode(F.slice(F.concat(equal, other), 1, NEAREST))
    return rows.select(F.col("p_partkey").alias("item"), found.alias("at", "one")).select("item", "one.candidate", "one.priority", (F.col("at") + 1).alias("place"))


@query("SELECT event_id, 'duplicate_logical_record' AS code FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn > 1")
def duplicate_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the last event of each user and type, as rejections."""
    return relational.duplicates_of(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], [F.col("event_id").desc()]).select("event_id", F.lit("duplicate_logical_record").alias("code"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def distinct_on_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    return relational.latest_of(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("""WITH a AS (SELECT event_type AS portal, max(event_id) AS attempt, max(event_id) FILTER (value >= 10) AS good, count(*) AS n FROM events GROUP BY 1)
SELECT portal, attempt, good, n, coalesce(attempt = good, false) AS healthy FROM a""")
def source_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each portal's latest attempt and latest good one."""
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("portal")).agg(F.max("event_id").alias("attempt"), F.max(F.when(F.col("value") >= 10, F.col("event_id"))).alias("good"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("healthy", F.coalesce(F.col("attempt") == F.col("good"), F.lit(False)))


@query("""WITH s AS (SELECT event_id, user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id, user_id, before, state FROM s WHERE before IS NOT NULL AND (before, state) NOT IN (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED) + ")")
def status_transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type may not follow the user's previous one."""
    steps = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("state"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("before"))
    allowed = spark.createDataFrame(list(ALLOWED), "before string, state string")
    return steps.where("before IS NOT NULL").join(allowed, ["before", "state"], "left_anti").select("event_id", "user_id", "before", "state")


BUCKETS = "b AS (SELECT user_id, CAST(epoch(ts) AS BIGINT) // 300 * 300 AS bucket, count(*) AS n, sum(CAST(value AS DECIMAL(14,4))) AS total FROM events GROUP BY ALL)"


@query(f"WITH {BUCKETS} SELECT user_id, bucket, n, total FROM b".replace("CAST(epoch(ts) AS BIGINT)", "CAST(floor(epoch(ts)) AS BIGINT)"))
def tumbling_5min_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets(read(spark, sf_dir, "events"))


def buckets(events: DataFrame) -> DataFrame:
    start = F.unix_seconds(F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"])
    return events.groupBy("user_id", start.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(14,4)")).alias("total"))


@query(f"WITH {BUCKETS} SELECT user_id, bucket, sum(n) OVER w AS n, sum(total) OVER w AS total FROM b WINDOW w AS (PARTITION BY user_id ORDER BY bucket RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)".replace("CAST(epoch(ts) AS BIGINT)", "CAST(floor(epoch(ts)) AS BIGINT)"))
def rolling_24h_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the 24 hours up to each five-minute bucket."""
    return rolling_totals(buckets(read(spark, sf_dir, "events")), ["user_id"], "bucket", ["n", "total"], 86_400)


ARRIVAL = "(event_id * 7919) % 1000003"


@query(f"""WITH a AS (SELECT event_id, event_type, event_id AS source_time, max(event_id) OVER (PARTITION BY event_type ORDER BY {ARRIVAL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM events)
SELECT event_id, event_type, watermark, CASE WHEN source_time < watermark THEN 'source_timestamp_regression' ELSE 'accepted' END AS verdict FROM a""")
def watermark_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in an order of arrival that isn't theirs, against the watermark of their type; of events that arrive at once, which the SQL leaves open, the smaller id comes first."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").alias("source_time"), F.expr(ARRIVAL).alias("arrival"))
    return history.regressions(events, ["event_type"], ["arrival", "event_id"], "source_time").select("event_id", "event_type", "watermark", "verdict")


@query(f"""WITH a AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(ts)) AS BIGINT) + ({ARRIVAL}) % 5000000 - 1000000 AS seen FROM events)
SELECT event_id, CASE WHEN t > seen + 86400 THEN 'future' WHEN t < seen - 2592000 THEN 'stale' ELSE 'accepted' END AS verdict FROM a""")
def late_and_future_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose time lies a day or more ahead of when they are seen, or 30 days behind."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = read(spark, sf_dir, "events").select("event_id", t.alias("t"), (t + F.expr(f"{ARRIVAL} % 5000000 - 1000000")).alias("seen"))
    return rows.select("event_id", F.when(F.col("t") > F.col("seen") + 86_400, "future").when(F.col("t") < F.col("seen") - 2_592_000, "stale").otherwise("accepted").alias("verdict"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (rn = greatest(1, CAST(ceil(n * 50 / 100) AS BIGINT))) AS p50, max(value) FILTER (rn = greatest(1, CAST(ceil(n * 95 / 100) AS BIGINT))) AS p95, max(value) FILTER (rn = greatest(1, CAST(ceil(n * 99 / 100) AS BIGINT))) AS p99 FROM r GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles; equal values are counted first, so a type's rows never meet in one array."""
    counts = read(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("last", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(Window.partitionBy("event_type")))
    at = lambda p: F.min(F.when(F.col("last") >= F.greatest(F.lit(1), F.ceil(F.col("all") * p / 100)), F.col("value"))).alias(f"p{p}")
    return rows.groupBy("event_type").agg(at(50), at(95), at(99))


ANCHOR = "'<a href=\"([^\"]*)\"[^>]*>([^<]*)</a>'"


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all(html, {ANCHOR}, 1) AS h, regexp_extract_all(html, {ANCHOR}, 2) AS t FROM pages), u AS (SELECT page_id, unnest(range(length(h))) AS position, h, t FROM l)
SELECT page_id, position, replace(h[position + 1], '&amp;', '&') AS href, trim(regexp_replace(replace(t[position + 1], '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM u""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages."""
    return links.extract(read(spark, sf_dir, "pages"))



@query("""SELECT page_id, CASE WHEN regexp_matches(s, '^prices?full') THEN 'price_full' WHEN regexp_matches(s, '^stores?') THEN 'stores' WHEN regexp_matches(s, '^prices?') THEN 'price_delta' END AS document_type,
CASE WHEN page_id % 4 = 0 THEN 'gzip' WHEN page_id % 4 = 1 THEN 'zip' ELSE 'none' END AS compression, '2024010' || (page_id % 9 + 1) || '0930' AS stamp
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pricefull729' WHEN 1 THEN 'stores729' ELSE 'price729' END AS s FROM pages)""")
def doc_type_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, compression and time stamp of file names made from the pages' ids."""
    name = F.concat(
        F.element_at(F.array(F.lit("PriceFull729"), F.lit("Stores729"), F.lit("Price729")), (F.col("page_id") % 3 + 1).cast("int")), F.lit("-001-2024010"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("-0930"),
        F.element_at(F.array(F.lit(".gz"), F.lit(".zip"), F.lit(".xml"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int")),
    )
    rows = read(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    return rows.select("page_id", text.document_type(F.col("name")).alias("document_type"), text.compression(F.col("name")).alias("compression"), text.file_timestamp(F.col("name")).alias("stamp"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size * 1000 AS DECIMAL(18,6)) WHEN 1 THEN CAST(p_size + 0.5 AS DECIMAL(18,6)) ELSE CAST(p_size AS DECIMAL(18,6)) END AS value,
CASE p_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'each' END AS unit, p_name AS rest FROM part""")
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of names made from the parts' sizes, in base units, and the names without them."""
    ends = F.array(F.lit(" kg"), F.lit(",5 ml"), F.lit(" יחידות"))
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.element_at(ends, (F.col("p_partkey") % 3 + 1).cast("int")))
    rows = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", text.quantity(F.col("name")).alias("q"), text.without_quantity(F.col("name")).alias("rest")).select("p_partkey", "q.value", "q.unit", "rest")


@query("SELECT sha256(text) AS fingerprint, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each fingerprint and the number of its copies."""
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@query("SELECT s_suppkey, s_name, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name), '0000') AND s_suppkey > 20 ORDER BY s_suppkey LIMIT 11")
def keyset_store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of stores whose name holds a text, behind a cursor, and one more."""
    found = read(spark, sf_dir, "supplier").where(F.lower("s_name").contains("0000") & relational.after([(F.col("s_suppkey"), F.lit(20), True)]))
    return relational.page(found.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_name").alias("city")), [F.col("s_suppkey")], 10)
