"""Ordered rules that classify jobs and skills; the first that holds wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that the platform's rules are stated in.
JUNK_TITLES = (r"^test$", r"^demo$", r"^\d{3}_cand", r"^(colombia|mexico|argentina)\s+(credo\s+)?test\s+\d+$")
SPANISH = r"\b(experiencia|años|requisitos|habilidades|conocimientos|desarrollo|ingeniero|empresa|buscamos|ofrecemos|ubicación|necesario|deseables|técnicas)\b"
ENGLISH = r"\b(experience|years|requirements|skills|knowledge|development|engineer|company|looking|offer|location|required|desirable|technical|responsibilities)\b"
QUALITY_TITLES = ("developer", "engineer", "desarrollador", "ingeniero", "programador", "devops", "data", "scientist", "analyst")
QUALITY_SKILLS = ("python", "java", "javascript", "react", "angular", "node", "aws", "azure", "docker", "kubernetes", "sql", "mongodb")
QUALITY_NOISE = ("window.", "function()", "getElementById", "<div", "<script")
MOBILE_TITLE = r"\bmobile\b|\bios\b|\bandroid\b|flutter|react native|móvil|movil"
MOBILE_TEXT = ("mobile developer", "mobile engineer", "desarrollador móvil", "desarrollador movil", "ingeniero móvil", "ingeniero movil", "ios developer", "ios engineer", "android developer", "android engineer", "flutter developer", "react native developer")
ROLES = (
    ("qa", ("qa", "test", "quality assurance", "automation test")),
    ("security", ("security", "cybersecurity", "infosec", "architect")),
    ("data_science", ("data scien", "machine learning", "ml engineer", "data analyst", "big data")),
    ("devops", ("devops", "sre", "site reliability", "platform engineer", "cloud engineer", "infrastructure")),
    ("frontend", ("frontend", "front-end", "front end")),
    ("backend", ("backend", "back-end", "back end", "api", "microservices", "server")),
    ("fullstack", ("full stack", "fullstack", "full-stack")),
)
FRONTEND_WORDS = ("react", "angular", "vue", "css", "html")
SENIOR = ("senior", "sr.", "lead", "staff", "principal", "architect")
JUNIOR = ("junior", "jr.", "trainee", "entry", "graduate")
SKILL_CLASSES = (
    ("languages", ("javascript", "python", "java", "c#", "c++", "go", "rust", "typescript", "php", "ruby", "kotlin", "swift")),
    ("frameworks", ("react", "angular", "vue", "django", "flask", "spring", "express", "nest", "laravel", "rails", ".net")),
    ("cloud", ("aws", "azure", "gcp", "cloud", "serverless", "lambda")),
    ("databases", ("sql", "postgres", "mysql", "mongodb", "redis", "oracle", "nosql", "database", "db")),
    ("devops", ("docker", "kubernetes", "ci/cd", "jenkins", "gitlab", "terraform", "ansible", "devops", "git")),
    ("methodologies", ("agile", "scrum", "kanban", "lean", "metodolog")),
    ("tools", ("github", "jira", "postman", "figma", "vscode")),
    ("concepts", ("microservicio", "api", "rest", "graphql", "arquitectura", "patrón", "testing", "seguridad", "escalabilidad", "performance")),
)
ACCEPT_WORDS = ("python", "java", "javascript", "react", "angular", "node", "aws", "docker", "kubernetes", "sql", "api", "backend", "frontend", "fullstack", "devops", "mobile", "ios", "android")
RED_FLAGS = ("director", "gerente", "bi engineer", "business intelligence", "mechanical", "chemical", "civil engineer")
ACRONYMS = {"programación orientada a objetos": ("poo", "oop"), "inteligencia artificial": ("ia", "ai"), "rest api": ("rest", "restful"), "ci/cd": ("ci", "cd", "continuous integration", "continuous deployment")}
ENTITY_WORDS = ("framework", "library", "tool", "platform", "service", "database", "language", "technology", "stack", "api", "cloud", "devops", "frontend", "backend", "fullstack")
ENTITY_PATTERN = r"\.js$|\.py$|\.net$|\.io$|\.com$|^[A-Z][a-z]+$|^[A-Z]+$"
NGRAM_NOISE = (r"^\d+$", r"^\d+[a-z]$", r"^[a-z]$", r"^\W+$", r"^(https?|www|http)", r"@", r"^\d+\s*(años?|years?|meses?|months?)$", r"^\d+\s+\w+", r"\d{3,}", r"^[A-Z]-[A-Z]")
LLM_NOISE = (r"^\d+\s*(años?|meses?|días?).*$", r"^[<>≥≤]\s*\d+", r"^\d+\s*-\s*\d+", r"^(de|en|con|para)\s+", r".*@.*\.(com|net|org)", r"^https?://", r"^\$\d+", r"^[\W_]+$", r"^.{1,2}$", r"^.{100,}$")


def has_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def count_of(text: Column, words: Iterable[str]) -> Column:
    """How many of the words the text holds."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def junk(title: Column, description: Column) -> Column:
    """Struct (is_junk, reason): short descriptions, then test titles."""
    text = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    reason = F.when(description.isNull() | (F.length(F.trim(description)) < 50), "Empty or extremely short description")
    for p in JUNK_TITLES:
        reason = reason.when(text.rlike(p), f"Test job pattern: {p}")
    return F.struct(reason.isNotNull().alias("is_junk"), reason.alias("reason"))


def language(text: Column) -> Column:
    """es, en or mixed: one language needs more than twice the other's words in the first 2000 characters."""
    head = F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 2000)
    es, en = F.regexp_count(head, F.lit("(?U)" + SPANISH)), F.regexp_count(head, F.lit("(?U)" + ENGLISH))
    return F.when(es > 2 * en, "es").when(en > 2 * es, "en").otherwise("mixed")


def quality_score(title: Column, description: Column, requirements: Column) -> Column:
    """0 to 100 from length, sections, title and skill words, less noise."""
    size = F.length(description) + F.length(requirements)
    score = F.lit(50) + F.when(size > 3000, 20).when(size > 2000, 15).when(size > 1000, 10).otherwise(0)
    score = score + F.when(F.length(requirements) > 100, 10).otherwise(0) + F.when(has_any(F.lower(title), QUALITY_TITLES), 10).otherwise(0)
    score = score + F.least(count_of(F.lower(F.concat(title, description, requirements)), QUALITY_SKILLS), F.lit(10))
    score = score - F.least(2 * count_of(description, QUALITY_NOISE), F.lit(10))
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def role(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, description))
    out = F.when(F.lower(title).rlike("(?U)" + MOBILE_TITLE) | has_any(text, MOBILE_TEXT), "mobile")
    for name, words in ROLES:
        found = has_any(text, words)
        if name == "frontend":
            found = found | (has_any(text, FRONTEND_WORDS) & ~F.contains(text, F.lit("backend")))
        out = out.when(found, name)
    return out.otherwise("other")


def seniority(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, description))
    return F.when(has_any(text, SENIOR), "senior").when(has_any(text, JUNIOR), "junior").otherwise("mid")


def skill_class(skill: Column) -> Column:
    text, out = F.lower(skill), None
    for name, words in SKILL_CLASSES:
        hit = has_any(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def acceptable(title: Column, description: Column, requirements: Column, role_name: Column) -> Column:
    """Struct (ok, reason) of the job review."""
    low = F.lower(title)
    flags = (F.contains(low, F.lit("manager")) & F.contains(low, F.lit("engineering"))) | has_any(low, RED_FLAGS) | (role_name == "other")
    n = count_of(F.lower(F.concat_ws(" ", title, description, requirements)), ACCEPT_WORDS)
    size = F.length(description) + F.length(requirements)
    reason = F.when(flags, F.lit("Contains red flag keywords")).when(n < 2, F.format_string("Only %d tech keywords found", n)).when(size < 800, F.format_string("Too short (%d chars)", size)).otherwise("Looks good")
    return F.struct((reason == "Looks good").alias("ok"), reason.alias("reason"))


def missing_reason(skill: Column, text: Column) -> Column:
    """Why a gold skill was not extracted: exact, variation, acronym or absent."""
    s, t = F.lower(skill), F.lower(text)
    acronym = F.lit(False)
    for full, short in ACRONYMS.items():
        acronym = acronym | (F.contains(s, F.lit(full)) & has_any(t, short))
    words = F.filter(F.split(s, r"\s+"), lambda w: F.length(w) > 3)
    return F.when(F.contains(t, s), "in_text_exact").when(F.exists(words, lambda w: F.contains(t, w)), "in_text_variation").when(acronym, "acronym").otherwise("not_in_text")


def entity_candidate(text: Column) -> Column:
    return has_any(F.lower(text), ENTITY_WORDS) | text.rlike(ENTITY_PATTERN)


def valid_skill(skill: Column) -> Column:
    """2 to 100 characters with a letter a-z."""
    return skill.isNotNull() & F.length(F.trim(skill)).between(2, 100) & skill.rlike("[a-zA-Z]")


def llm_skill(skill: Column, blacklist: tuple[str, ...] = ()) -> Column:
    """Struct (is_valid, confidence, reason) of the heuristic validator."""
    s = F.trim(skill)
    reason = F.when(s.isNull() | (s == ""), "Empty skill").when(F.length(s) < 2, "Too short").when(F.length(s) > 100, "Too long")
    if blacklist:
        reason = reason.when(F.lower(s).isin(*blacklist), "Blacklisted term")
    for p in LLM_NOISE:
        reason = reason.when(s.rlike("(?iU)^(?:" + p + ")"), f"Matches noise pattern: {p}")
    return F.struct(reason.isNull().alias("is_valid"), F.when(reason.isNull(), 0.7).otherwise(0.0).alias("confidence"), F.coalesce(reason, F.lit("Passed heuristic checks")).alias("reason"))


def ngram_noise(ngram: Column) -> Column:
    return ngram.rlike("(?i)" + "|".join(f"(?:{p})" for p in NGRAM_NOISE))
