"""Readers: tables, taxonomy files, JSON and Markdown documents, pages, logs and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import records as R
from vacantia.functions import text as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **params: object) -> DataFrame:
    """A parameterised statement over named frames; values are bound, never pasted."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=params or None)


def not_done(df: DataFrame, done: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows that no finished row has the key of."""
    return df.join(done.select(key), key, "left_anti")


_TAXONOMY = "conceptType string, conceptUri string, preferredLabel string, status string, skillType string, reuseLevel string, altLabels string, description string, broaderConceptUri string, broaderConceptPT string"


def taxonomy_csv(spark: SparkSession, collections: dict[str, str]) -> DataFrame:
    """Collections of a skill taxonomy: group name to path of a CSV with quoted, multi-line cells.

    The first collection's row of a URI stays; alternative labels become an array.
    """
    out = None
    for rank, (group, path) in enumerate(collections.items()):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        want = [c.split()[0] for c in _TAXONOMY.split(", ")]
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in want]).withColumns({"skill_group": F.lit(group), "_rank": F.lit(rank)})
        out = rows if out is None else out.unionByName(rows)
    labels = F.filter(F.transform(F.split(F.coalesce("altLabels", F.lit("")), r"\s*\|\s*|\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = out.groupBy("conceptUri").agg(F.min_by(F.struct(*[c for c in out.columns if c != "conceptUri"]), "_rank").alias("r")).select("conceptUri", "r.*")
    return first.select(F.col("conceptUri").alias("skill_uri"), F.trim("preferredLabel").alias("label"), labels.alias("alt_labels"), "description", F.col("skillType").alias("skill_type"), "skill_group", F.col("broaderConceptUri").alias("broader_uri")).where("skill_uri is not null")


def hot_technologies_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Technology examples of occupations; ``hot`` and ``in_demand`` from Y and N."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    flag = lambda c: (F.col(f"`{c}`") == "Y") if c in rows.columns else F.lit(False)
    return rows.select(F.trim(F.col("`Example`")).alias("label"), F.col("`Commodity Title`").alias("skill_group"), flag("Hot Technology").alias("hot"), flag("In Demand").alias("in_demand")).where("label is not null").distinct()


def json_document(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of the paths that exists; a multi-line JSON document."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return spark.read.schema(schema).option("multiLine", True).json(p)
    raise FileNotFoundError(", ".join(paths))


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """``path``, ``name``, ``size_kb``, ``modified`` of the files that match; contents are not read."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.round(F.col("length") / 1024, 2).alias("size_kb"), F.col("modificationTime").alias("modified"))


def configurations(files: DataFrame) -> DataFrame:
    """Run names ``pipeline_size_stage`` read from the folder of each file."""
    name = F.element_at(F.split("path", "/"), -2)
    parts = F.split(name, "_")
    n = F.size(parts)
    return files.select(name.alias("config"), F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(1))), "_").alias("pipeline"), F.when(n >= 3, F.element_at(parts, -2)).alias("size"), F.when(n >= 2, F.element_at(parts, -1)).alias("stage")).distinct()


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """``job_num``, ``job_id``, ``hard_skills``, ``soft_skills``, ``notes`` from Markdown sheets of annotated jobs.

    A section counts if its box for a valid job is ticked; lines that say they are pending are left out.
    """
    text = spark.read.text(path, wholetext=True)
    sections = text.select(F.explode(F.split("value", r"(?m)^## Job #")).alias("s")).where(F.col("s").rlike(r"^\d+") & F.col("s").contains("- [x] **Es software/tech job válido**"))
    block = lambda title: F.regexp_extract("s", r"(?s)\*\*" + title + r"\*\*:\s*```\s*(.*?)\s*```", 1)
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("(PENDIENTE")))
    notes = F.trim(block("Comentarios"))
    return sections.select(F.regexp_extract("s", r"^(\d+)", 1).cast("int").alias("job_num"), F.regexp_extract("s", r"\*\*Job ID\*\*: `([^`]+)`", 1).alias("job_id"), lines(block("Hard Skills")).alias("hard_skills"), lines(block("Soft Skills")).alias("soft_skills"), F.when(~F.startswith(notes, F.lit("(PENDIENTE")), notes).alias("notes"))


def annotation_rows(sheets: DataFrame) -> DataFrame:
    """``job_id``, ``skill_text``, ``skill_type``, each once."""
    kinds = F.array(*[F.struct(F.lit(k).alias("skill_type"), F.col(f"{k}_skills").alias("skills")) for k in ("hard", "soft")])
    rows = sheets.select("job_id", F.explode(kinds).alias("k")).select("job_id", "k.skill_type", F.explode("k.skills").alias("skill_text"))
    return rows.select("job_id", "skill_text", "skill_type").distinct()


def postings(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Job rows from pages that hold a JSON-LD posting; pages without one drop out."""
    p = pages.select(F.col(url).alias("url"), R.job_posting(F.col(html)).alias("p")).where("p is not null")
    split = R.split_requirements(F.coalesce("p.description", F.lit("")))
    value = F.col("p.baseSalary.value.value")
    pay = F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit("$ "), value, F.lit(" "), F.coalesce("p.baseSalary.value.currency", "p.baseSalary.currency", F.lit("COP")), F.lit(" ("), F.coalesce("p.baseSalary.unitText", F.lit("Mensual")), F.lit(")"))).otherwise("")
    return p.select(
        "url",
        F.coalesce("p.title", F.lit("")).alias("title"),
        F.coalesce("p.hiringOrganization.name", F.lit("")).alias("company"),
        R.location(F.col("p.jobLocation.address.addressLocality"), F.col("p.jobLocation.address.addressRegion")).alias("location"),
        split["description"].alias("description"),
        split["requirements"].alias("requirements"),
        pay.alias("salary_raw"),
        F.coalesce(R.employment_type(F.col("p.employmentType")), F.lit("")).alias("contract_type"),
        R.iso_date(F.col("p.datePosted")).alias("posted_date"),
    )


def page_records(pages: DataFrame, fields: dict[str, str], url: str = "url", html: str = "html") -> DataFrame:
    """Job rows by a portal's table of fields: name to a pattern whose first group is the value; tags are stripped."""
    got = [T.breaks_to_space(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), pattern, 1)).alias(name) for name, pattern in fields.items()]
    return pages.select(F.col(url).alias("url"), *got)


#: A table of fields that fits plain pages.
PLAIN_PAGE = {"title": r"(?is)<h1[^>]*>(.*?)</h1>", "description": r"(?is)<article[^>]*>(.*?)</article>", "language": r'(?is)<html[^>]*lang="([^"]+)"'}


def rest_records(rows: DataFrame) -> DataFrame:
    """Job rows from nested API records: id, apply_url, job_information, v5_processed_job_data."""
    p, i = "v5_processed_job_data", "job_information"
    return rows.select(
        F.col("apply_url").alias("url"),
        F.coalesce(f"{i}.title", f"{p}.core_job_title", F.lit("")).alias("title"),
        F.coalesce(f"{p}.company_name", F.lit("")).alias("company"),
        F.coalesce(f"{p}.formatted_workplace_location", F.lit("")).alias("location"),
        T.breaks_to_space(F.coalesce(f"{i}.description", F.lit(""))).alias("description"),
        F.coalesce(f"{p}.requirements_summary", F.lit("")).alias("requirements"),
        R.yearly_pay(F.col(f"{p}.is_compensation_transparent"), F.col(f"{p}.yearly_min_compensation"), F.col(f"{p}.yearly_max_compensation"), F.lit("USD")).alias("salary_raw"),
        R.workplace_type(F.col(f"{p}.workplace_type")).alias("remote_type"),
    )


def progress_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """Per log file: items scraped, errors, warnings, and whether it ended."""
    lines = spark.read.text(pattern).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    count = F.max(F.try_to_number(F.nullif(F.regexp_extract("value", r"'item_scraped_count': (\d+)", 1), F.lit("")), F.lit("9999999999")).cast("long"))
    return lines.groupBy("file").agg(count.alias("items"), F.count_if(F.col("value").rlike(r"\bERROR\b")).alias("errors"), F.count_if(F.col("value").rlike(r"\bWARNING\b")).alias("warnings"), F.bool_or(F.col("value").contains("Spider closed")).alias("finished"), F.count(F.lit(1)).alias("lines"))


def llm_skills(answers: DataFrame, id_col: str = "job_id", answer: str = "answer") -> DataFrame:
    """``job_id``, ``skill_type``, ``skill_text`` from models' JSON answers ``{type: [skills]}``; broken answers are repaired or dropped."""
    rows = answers.select(F.col(id_col).alias("job_id"), F.from_json(R.repair_json(answer), "map<string,array<string>>").alias("m")).where("m is not null")
    pairs = rows.select("job_id", F.explode("m").alias("kind", "skills"))
    kind = F.when(F.col("kind") == "hard_skills", "hard").when(F.col("kind") == "soft_skills", "soft").otherwise(F.col("kind"))
    return pairs.select("job_id", kind.alias("skill_type"), F.explode("skills").alias("skill_text")).where("trim(skill_text) <> ''")
