"""Plans over single fields and rows: text forms, record fields, validators, status changes, unions of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import records as R
from vacantia.functions import rules
from vacantia.functions import text as T
from vacantia.operators import extract, filters, screening
from vacantia.plans import standins as S
from vacantia.plans.registry import register
from vacantia.plans.standins import table
from vacantia.sources import writers


def _replaced(col: str) -> str:
    for entity, char in T.BASIC_ENTITIES:
        col = f"replace({col}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return col


_PLAIN = f"translate(%s, '{T._MARKED}', '{T._PLAIN}')"
_FORM = r"trim(regexp_replace(regexp_replace(" + _PLAIN % "lower(%s)" + r", '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@register(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<br ?/?>', ' ', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def pages_without_breaks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.breaks_to_space("html").alias("text"))


@register(f"SELECT page_id, {_replaced('html')} AS html FROM pages")
def pages_decoded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.basic_unescape("html").alias("html"))


@register(r"SELECT doc_id, sha256(regexp_replace(text, '([!?]){2,}', '\1', 'g')) AS folded, sha256(regexp_replace(text, '[\x{10000}-\x{10FFFF}\x{2600}-\x{27BF}]', '', 'g')) AS plain FROM documents")
def title_marks(spark: SparkSession, d: str) -> DataFrame:
    """Digests of all texts without repeated marks, and without emojis."""
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold_punctuation("text"), 256).alias("folded"), F.sha2(T.remove_emojis("text"), 256).alias("plain"))


@register(rf"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS normal, sha256({_PLAIN % 'text'}) AS unmarked, sha256({_FORM % 'text'}) AS matching FROM documents")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the normal form, the form without marks and the matching form of all texts."""
    forms = {"normal": T.normalize_text("text"), "unmarked": T.strip_marks("text"), "matching": T.matching_form("text")}
    return table(spark, d, "documents").select("doc_id", *[F.sha2(c, 256).alias(n) for n, c in forms.items()])


_CODES = "CASE o_orderkey % 5 WHEN 0 THEN 'FULL_TIME' WHEN 1 THEN 'PART_TIME' WHEN 2 THEN 'CONTRACTOR' WHEN 3 THEN 'TEMPORARY' ELSE o_orderpriority END"


def _case(col: str, table_: dict[str, str], other: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {other} END"


@register(f"SELECT o_orderkey AS job_id, {_case(_CODES, R.EMPLOYMENT, _CODES)} AS employment FROM orders")
def employment_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), R.employment_type(F.expr(_CODES)).alias("employment"))


@register("""WITH p AS (SELECT o_orderkey AS k, nullif(o_custkey, 0) AS low, CASE WHEN o_orderkey % 3 <> 0 THEN nullif(o_orderkey, 0) END AS high FROM orders)
SELECT k AS job_id, CASE WHEN k % 4 = 0 THEN 'Not disclosed' WHEN low IS NOT NULL AND high IS NOT NULL THEN low || '-' || high || ' USD/year' WHEN low IS NOT NULL THEN low || '+ USD/year'
 WHEN high IS NOT NULL THEN 'Up to ' || high || ' USD/year' ELSE 'Not disclosed' END AS pay FROM p""")
def pay_ranges(spark: SparkSession, d: str) -> DataFrame:
    high = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), R.yearly_pay(F.col("o_orderkey") % 4 != 0, F.col("o_custkey"), high, F.lit(None).cast("string")).alias("pay"))


@register("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, d, "events").select("event_id", R.iso_date(said).alias("day"))


@register("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN n_name ELSE n_name || ', ' || r_name END AS location FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def job_locations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))), F.expr("c_nationkey = n_nationkey"))
    place = R.location(F.when(F.col("c_custkey") % 5 != 0, F.col("n_name")), F.when(F.col("c_custkey") % 3 != 0, F.col("r_name")))
    return rows.select(F.col("c_custkey").alias("id"), place.alias("location"))


@register("SELECT DISTINCT skill_text, length(trim(skill_text)) BETWEEN 2 AND 100 AND regexp_matches(skill_text, '[a-zA-Z]') AS valid FROM extracted_skills")
def skill_validation(spark: SparkSession, d: str) -> DataFrame:
    return S.extracted_skills(spark, d).select("skill_text", rules.valid_skill(F.col("skill_text")).alias("valid")).distinct()


@register(r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS w FROM benchmark UNION SELECT DISTINCT unnest(string_split_regex(text, '\s+')) FROM documents)
SELECT w AS skill_text, CASE WHEN lower(trim(w)) IN ('the', 'and', 'von') THEN true WHEN length(w) <= 2 THEN upper(trim(w)) NOT IN ('IN', 'DE') WHEN regexp_matches(regexp_replace(w, '[ .]', '', 'g'), '^[0-9]+$') THEN true
 WHEN NOT regexp_matches(w, '[\p{L}\p{N}]') THEN true WHEN contains(',;:+·•-', w[1]) THEN true ELSE false END AS garbage FROM w WHERE w <> ''""")
def garbage_skills(spark: SparkSession, d: str) -> DataFrame:
    """The garbage rules over every word of the corpus."""
    words = lambda n: table(spark, d, n).select(F.explode(F.split("text", r"\s+")).alias("skill_text"))
    rows = words("benchmark").unionByName(words("documents")).where("skill_text <> ''").distinct()
    return rows.withColumn("garbage", screening.garbage(F.col("skill_text"), ("the", "and", "von"), ("in", "de")))


_TECH = " OR ".join(f"contains(t, '{w}')" for w in screening.TECH_TITLES)
_OTHER = " OR ".join(f"contains(t, '{w}')" for w in screening.OTHER_TITLES)
_JOBS = "SELECT job_id, country, language, CASE job_id % 6 WHEN 0 THEN 'Backend Developer' WHEN 1 THEN 'Engineer' WHEN 2 THEN 'Project Manager' WHEN 3 THEN 'Full-time stack QA' WHEN 4 THEN 'Civil Engineer' ELSE title END AS title, CAST(salary AS BIGINT) AS size FROM raw_jobs"


def _titled(spark: SparkSession, d: str) -> DataFrame:
    title = F.expr("CASE job_id % 6 WHEN 0 THEN 'Backend Developer' WHEN 1 THEN 'Engineer' WHEN 2 THEN 'Project Manager' WHEN 3 THEN 'Full-time stack QA' WHEN 4 THEN 'Civil Engineer' ELSE title END")
    return S.raw_jobs(spark, d).select("job_id", "country", "language", title.alias("title"), F.rint("salary").cast("long").alias("size"))


@register(f"WITH j AS ({_JOBS}), t AS (SELECT *, lower(title) AS t FROM j) SELECT job_id, (({_TECH} OR t LIKE '%full%stack%') AND NOT ({_OTHER})) AS wanted, trim(t) NOT IN {screening.GENERIC_TITLES} AND (job_id % 3 <> 0 OR size >= 95) AS specific FROM t")
def title_screening(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("job_id") % 3 == 0, "other").otherwise("backend")
    return _titled(spark, d).select("job_id", screening.wanted_title(F.col("title")).alias("wanted"), screening.specific(F.col("title"), role, F.col("size")).alias("specific"))


@register(f"""WITH j AS ({_JOBS}), f AS (SELECT * FROM j WHERE job_id NOT IN (SELECT job_id FROM gold)), r AS (SELECT country, language, job_id, size, row_number() OVER (PARTITION BY country, language ORDER BY size DESC, job_id) AS rank FROM f WHERE language = 'es')
SELECT country, language, job_id, size, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def replacement_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The ten longest jobs of each country in Spanish that aren't annotated."""
    jobs = _titled(spark, d).drop("title")
    return screening.replacements(jobs.where("language = 'es'"), jobs, S.gold(spark, d)).select("country", "language", "job_id", "size", "rank")


@register("""WITH s AS (SELECT l_orderkey AS job_id, list(CASE WHEN l_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END ORDER BY l_linenumber, l_partkey) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT job_id, array_to_string([items[i] FOR i IN range(1, len(items) + 1) IF list_position([lower(x) FOR x IN items], lower(items[i])) = i], '|') AS skills FROM s""")
def ordered_skills(spark: SparkSession, d: str) -> DataFrame:
    """Each job's skills in order, without those that repeat in another case."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    item = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    rows = l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_sort(F.collect_list(item)).alias("i"))
    return rows.select("job_id", F.array_join(screening.distinct_in_order(F.transform("i", lambda x: x["name"])), "|").alias("skills"))


@register("SELECT source, count(*) AS n, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM documents GROUP BY 1")
def upper_medians(spark: SparkSession, d: str) -> DataFrame:
    return screening.upper_median(table(spark, d, "documents"), "n_chars", "source")


@register("SELECT llm_model, count(*) AS n, round(avg(processing_time_seconds), 6) AS mean, round(stddev_samp(processing_time_seconds), 6) AS stdev, min(processing_time_seconds) AS least, max(processing_time_seconds) AS most FROM enhanced_skills GROUP BY 1")
def timing_stats(spark: SparkSession, d: str) -> DataFrame:
    """Processing times with the sample standard deviation."""
    t = F.col("processing_time_seconds")
    return S.enhanced_skills(spark, d).groupBy("llm_model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(t), 6).alias("mean"), F.round(F.stddev_samp(t), 6).alias("stdev"), F.min(t).alias("least"), F.max(t).alias("most"))


@register("""SELECT count(DISTINCT job_id) AS total_documents, count(*) AS total_skills, round(count(*) / count(DISTINCT job_id), 6) AS skills_per_document, count(DISTINCT skill_text) AS unique_skills,
 count(*) FILTER (len(string_split(skill_text, ' ')) = 1) AS unigrams, count(*) FILTER (len(string_split(skill_text, ' ')) = 2) AS bigrams, count(*) FILTER (len(string_split(skill_text, ' ')) = 3) AS trigrams, round(avg(confidence_score), 4) AS mean_confidence FROM extracted_skills""")
def ngram_stats(spark: SparkSession, d: str) -> DataFrame:
    """Extraction statistics by n-gram length."""
    size = F.size(F.split("skill_text", " "))
    return S.extracted_skills(spark, d).agg(
        F.count_distinct("job_id").alias("total_documents"),
        F.count(F.lit(1)).alias("total_skills"),
        F.round(F.count(F.lit(1)) / F.count_distinct("job_id"), 6).alias("skills_per_document"),
        F.count_distinct("skill_text").alias("unique_skills"),
        *[F.count_if(size == n).alias(name) for n, name in ((1, "unigrams"), (2, "bigrams"), (3, "trigrams"))],
        F.round(F.avg("confidence_score"), 4).alias("mean_confidence"),
    )


@register("""WITH u AS (SELECT 'a' AS source, job_id, skill_text, esco_uri, extraction_method AS method FROM extracted_skills WHERE extraction_method IN ('ner', 'regex') UNION ALL SELECT 'b', job_id, normalized_skill, esco_concept_uri, 'pipeline_b' FROM enhanced_skills UNION ALL SELECT 'm', job_id, skill_text, NULL, 'manual' FROM gold)
SELECT source, method, count(*) AS n, count(esco_uri) AS mapped, count(DISTINCT skill_text) AS skills FROM u GROUP BY 1, 2""")
def unified_sources(spark: SparkSession, d: str) -> DataFrame:
    """The three skill sources in one shape."""
    parts = {"a": filters.skills(filters.unified(S.extracted_skills(spark, d), "pipeline_a"), method="pipeline_a"), "b": filters.unified(S.enhanced_skills(spark, d), "pipeline_b"), "m": filters.unified(S.gold(spark, d), "manual")}
    rows = None
    for name, part in parts.items():
        part = part.withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("source", F.col("extraction_method").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.count("esco_uri").alias("mapped"), F.count_distinct("skill_text").alias("skills"))


@register("""WITH u AS (SELECT DISTINCT job_id, skill_text, extraction_method AS method, CASE extraction_method WHEN 'regex' THEN 0 WHEN 'ner' THEN 1 ELSE 2 END AS k FROM extracted_skills),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, lower(trim(skill_text)) ORDER BY k) AS n FROM u) SELECT job_id AS doc_id, skill_text, method FROM r WHERE n = 1""")
def combined_methods(spark: SparkSession, d: str) -> DataFrame:
    """Patterns, then entities, then TF-IDF: the earlier method keeps a name."""
    rows = S.extracted_skills(spark, d).select(F.col("job_id").alias("doc_id"), "skill_text", F.col("extraction_method").alias("method"), F.lit(0.8).alias("confidence"), F.lit(0).alias("start")).distinct()
    return extract.combine(*[rows.where(F.col("method") == m) for m in ("regex", "ner", "tfidf")]).select("doc_id", "skill_text", "method")


@register(rf"""WITH l AS (SELECT DISTINCT array_to_string(string_split({_FORM % 'text'}, ' ')[1:2], ' ') AS ngram FROM benchmark), d AS (SELECT doc_id, string_split({_FORM % 'text'}, ' ') AS w FROM documents),
g AS (SELECT doc_id, unnest([{{'ngram': w[i] || ' ' || w[i + 1], 'start': i - 1}} FOR i IN range(1, len(w))]) AS g FROM d) SELECT doc_id, g.ngram AS ngram, CAST(min(g.start) AS INT) AS start, count(*) AS n, 0.6 AS confidence FROM g JOIN l ON g.ngram = l.ngram GROUP BY 1, 2""")
def entity_ruler(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of a gazetteer in all documents, as an entity ruler finds them; the first two words of the benchmark stand in for it."""
    first = F.array_join(F.slice(F.split(T.matching_form("text"), " "), 1, 2), " ")
    labels = table(spark, d, "benchmark").select(first.alias("label")).distinct().withColumn("skill_id", F.col("label"))
    found = extract.dictionary_matches(table(spark, d, "documents"), labels, most=2).where("size = 2")
    return found.groupBy("doc_id", "ngram").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n")).withColumn("confidence", F.lit(0.6))


@register("""SELECT o_orderkey AS job_id, CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'pending' END AS extraction_status, CASE WHEN o_orderkey % 3 = 1 THEN 3 ELSE 2 END AS extraction_attempts,
 CASE WHEN o_orderkey % 3 = 1 THEN 'late' WHEN o_orderkey % 3 = 2 THEN 'old' END AS extraction_error, o_orderkey % 3 = 0 AS done FROM orders""")
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after the updates of a stage: completed, failed, or none."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("pending").alias("extraction_status"), F.lit(None).cast("timestamp").alias("extraction_completed_at"), F.lit(2).alias("extraction_attempts"), F.lit("old").alias("extraction_error"))
    updates = jobs.where("job_id % 3 < 2").select("job_id", F.when(F.col("job_id") % 3 == 0, "completed").otherwise("failed").alias("status"), F.lit("late").alias("error"))
    after = writers.with_status(jobs, updates, "extraction", F.lit("2024-01-01").cast("timestamp"))
    return after.select("job_id", "extraction_status", "extraction_attempts", "extraction_error", F.col("extraction_completed_at").isNotNull().alias("done"))


@register("""WITH old AS (SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey AS id, upper(p_name) AS name, -p_size AS size FROM part WHERE p_partkey % 2 = 0)
SELECT 'all' AS way, id, name, size FROM new UNION ALL SELECT 'all', * FROM old WHERE id NOT IN (SELECT id FROM new)
UNION ALL SELECT 'name', coalesce(o.id, n.id), coalesce(n.name, o.name), coalesce(o.size, n.size) FROM old o FULL JOIN new n ON o.id = n.id""")
def upserts(spark: SparkSession, d: str) -> DataFrame:
    """An upsert of whole rows, and one of the name only."""
    part = table(spark, d, "part")
    old = part.where("p_partkey % 3 <> 0").selectExpr("p_partkey AS id", "p_name AS name", "p_size AS size")
    new = part.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "upper(p_name) AS name", "-p_size AS size")
    ways = {"all": writers.merged(old, new, ["id"]), "name": writers.merged(old, new, ["id"], ["name"])}
    a, b = (df.withColumn("way", F.lit(n)) for n, df in ways.items())
    return a.unionByName(b)


@register("SELECT e.job_id, e.skill_text, coalesce(m.uri, e.esco_uri) AS esco_uri, count(*) AS n FROM extracted_skills e LEFT JOIN (SELECT label, min('map:' || skill_id) AS uri FROM esco_skills WHERE skill_id % 2 = 0 GROUP BY 1) m ON lower(trim(e.skill_text)) = lower(trim(m.label)) GROUP BY 1, 2, 3")
def mapping_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Taxonomy addresses written to all skills with the text of a mapping."""
    mapping = S.esco_skills(spark, d).where("skill_id % 2 = 0").select(F.col("label").alias("skill_text"), F.concat(F.lit("map:"), F.col("skill_id").cast("string")).alias("esco_uri"))
    return writers.fan_out(S.extracted_skills(spark, d), mapping).groupBy("job_id", "skill_text", "esco_uri").agg(F.count(F.lit(1)).alias("n"))
