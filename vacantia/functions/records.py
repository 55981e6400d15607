"""Record normalisers: dates, money, contracts, addresses, JSON-LD and LLM answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Names and patterns of the portals' formats.
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
EMPLOYMENT = {"FULL_TIME": "Tiempo completo", "PART_TIME": "Medio tiempo", "CONTRACTOR": "Contratista", "TEMPORARY": "Temporal", "INTERN": "Pasante", "VOLUNTEER": "Voluntario", "PER_DIEM": "Por día", "OTHER": "Otro"}
CONTRACT_WORDS = (("tiempo completo", "Tiempo completo"), ("tiempo parcial", "Medio tiempo"), ("contrato", "Contrato"), ("permanente", "Permanente"), ("temporal", "Temporal"), ("indefinido", "Indefinido"), ("determinado", "Determinado"), ("freelance", "Freelance"), ("independiente", "Independiente"), ("plazo fijo", "Plazo fijo"), ("obra labor", "Obra labor"))
REMOTE_WORDS = (("remoto", "Remoto"), ("teletrabajo", "Remoto"), ("home office", "Remoto"), ("presencial", "Presencial"), ("híbrido", "Híbrido"), ("hibrido", "Híbrido"), ("mixto", "Híbrido"), ("a distancia", "Remoto"))
WORKPLACES = {"remote": "Remote", "work from home": "Remote", "wfh": "Remote", "hybrid": "Hybrid", "hybrid remote": "Hybrid", "onsite": "Onsite", "on-site": "Onsite", "in-office": "Onsite", "office": "Onsite"}
SALARY = (r"\$\s*([\d.,]+)\s*(?:COP|pesos?|pesos colombianos?)", r"Salario:\s*\$\s*([\d.,]+)", r"\$\s*([\d.,]+)\s*\+?\s*prestaciones", r"([\d.,]+)\s*COP", r"([\d.,]+)\s*pesos", r"Salario:\s*([\d.,]+)", r"Apoyo\s+económico\s+de\s*\$\s*([\d.,]+)", r"([\d.,]+)\s*\+?\s*prestaciones")
REQUIREMENT_STARTS = ("Se requiere", "Requisitos", "Experiencia", "Educación", "Formación", "Conocimientos", "Habilidades", "Competencias", "Certificaciones", "Licencia", "Edad", "Género", "Disponibilidad", "Horario", "Modalidad")
REQUIREMENT_PHRASES = ("mínimo de", "mínima de", "al menos", "por lo menos", "preferiblemente", "deseable", "opcional", "obligatorio", "indispensable", "necesario", "requerido", "exigido")


def _first_word(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for word, value in table:
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise("")


def contract_type(text: Column) -> Column:
    return _first_word(text, CONTRACT_WORDS)


def remote_type(text: Column) -> Column:
    return _first_word(text, REMOTE_WORDS)


def _mapped(key: Column, table: dict[str, str]) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, key)


def employment_type(code: Column) -> Column:
    """Known codes by name, others as they are."""
    return F.coalesce(_mapped(code, EMPLOYMENT), code)


def workplace_type(name: Column) -> Column:
    key = F.lower(F.trim(name))
    return F.when(name.isNull() | (name == ""), "Not specified").otherwise(F.coalesce(_mapped(key, WORKPLACES), F.initcap(key)))


def salary(text: Column) -> Column:
    """``$ 1,234,567 COP`` from the first pattern whose amount is a number; or the note that it is confidential."""
    out = None
    for p in SALARY:
        digits = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + p, 1), "[.,]", "")
        hit = digits.rlike("^[0-9]+$")
        value = F.concat(F.lit("$ "), F.format_number(F.when(hit, digits).cast("decimal(38,0)"), 0), F.lit(" COP"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.when(F.coalesce(text, F.lit("")).rlike(r"(?i)salario\s+confidencial"), "Salario confidencial").otherwise("")


def yearly_pay(transparent: Column, low: Column, high: Column, currency: Column) -> Column:
    """Pay range of a JSON record."""
    a, b = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    unit = F.concat(F.lit(" "), F.coalesce(currency, F.lit("USD")), F.lit("/year"))
    given = F.when(a.isNotNull() & b.isNotNull(), F.concat(a.cast("string"), F.lit("-"), b.cast("string"), unit)).when(a.isNotNull(), F.concat(a.cast("string"), F.lit("+"), unit)).when(b.isNotNull(), F.concat(F.lit("Up to "), b.cast("string"), unit))
    return F.when(~F.coalesce(transparent, F.lit(False)), "Not disclosed").otherwise(F.coalesce(given, F.lit("Not disclosed")))


def requirements(text: Column) -> Column:
    """Sentences that begin with or hold a requirement word, sorted, joined by ``; ``."""
    t = F.coalesce(text, F.lit(""))
    starts = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(f"(?iU)({p}" + r"[^.]*(?:\.|$))"), 1) for p in REQUIREMENT_STARTS]))
    sentences = F.filter(F.transform(F.split(t, "[.!?]"), lambda s: F.trim(s)), lambda s: s.rlike("(?iU)" + "|".join(REQUIREMENT_PHRASES)))
    every = F.array_union(F.transform(starts, lambda s: F.trim(s)), sentences)
    return F.array_join(F.array_sort(F.filter(every, lambda s: F.length(s) > 10)), "; ")


def location(locality: Column, region: Column) -> Column:
    return F.when(F.coalesce(locality, F.lit("")) == "", "").otherwise(F.concat_ws(", ", locality, F.nullif(region, F.lit(""))))


def split_requirements(description: Column) -> Column:
    """Struct (description, requirements) cut at the portal's marker."""
    parts = F.split(description, "-Requerimientos-")
    return F.struct(F.when(F.size(parts) > 1, F.trim(parts[0])).otherwise(description).alias("description"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("requirements"))


def posted_date(text: Column, today: Column) -> Column:
    """A date from ``hoy``, ``ayer``, ``hace N días``, DD/MM/YYYY, DD-MM-YYYY or a day with a Spanish month; null if none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    number = F.regexp_extract(t, r"hace\s+(\d+)\s+d[ií]as?", 1)
    weeks = F.regexp_extract(t, r"hace\s+(\d+)\s+semanas?", 1)
    day, month, year = (F.regexp_extract(t, r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", k) for k in (1, 2, 3))
    d2, name, y2 = (F.regexp_extract(t, r"(\d{1,2})\s+(?:de\s+)?(\p{L}{3})\p{L}*\.?\s+(?:de\s+)?(\d{4})", k) for k in (1, 2, 3))
    months = F.array(*[F.lit(m) for m in MONTHS])
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return (
        F.when(number != "", F.date_sub(today, F.try_to_number(number, F.lit("99999")).cast("int")))
        .when(weeks != "", F.date_sub(today, 7 * F.try_to_number(weeks, F.lit("99999")).cast("int")))
        .when(t.rlike(r"\bhoy\b|hace\s+\d+\s+(?:horas?|minutos?)"), today)
        .when(t.rlike(r"\bayer\b"), F.date_sub(today, 1))
        .when(day != "", made(year, month, day))
        .when(d2 != "", made(y2, F.array_position(months, name).cast("string"), d2))
    )


def iso_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00"))))


def canonical_url(url: Column, key: str = "jk") -> Column:
    """The address without query and fragment, but for the one parameter that names the job."""
    base = F.regexp_replace(url, r"[?#].*$", "")
    value = F.try_parse_url(url, F.lit("QUERY"), F.lit(key))
    return F.when(value.isNotNull(), F.concat(base, F.lit(f"?{key}="), value)).otherwise(base)


JOB_POSTING = "`@type` string, title string, description string, datePosted string, employmentType string, hiringOrganization struct<name:string>, jobLocation struct<address:struct<addressLocality:string,addressRegion:string>>, baseSalary struct<currency:string,unitText:string,value:struct<value:string,currency:string>>"


def job_posting(page: Column) -> Column:
    """The first JSON-LD object of type JobPosting in a page, as a struct; null if there is none."""
    scripts = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    parsed = F.transform(scripts, lambda s: F.from_json(s, JOB_POSTING))
    return F.get(F.filter(parsed, lambda x: x["@type"] == "JobPosting"), F.lit(0))


@pandas_udf(StringType())
def repair_json(answer: pd.Series) -> pd.Series:
    """A JSON object from a model's answer: fences go, a bare array becomes ``{"skills": [...]}``, missing ends are added; null if it can't be read."""

    def one(text: str) -> str | None:
        body = re.sub(r"```(?:json)?", "", text).strip()
        at = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
        if at < 0:
            return None
        body, stack, quoted, skip, end = body[at:], [], False, False, None
        for i, ch in enumerate(body):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif ch in "}]":
                while stack and stack[-1] != ch:
                    body = body[:i] + stack.pop() + body[i:]
                    return one(body)
                if stack:
                    stack.pop()
                if not stack:
                    end = i + 1
                    break
        body = body[:end] if end else re.sub(r",\s*$", "", body + '"' * quoted) + "".join(reversed(stack))
        try:
            got = json.loads(re.sub(r",(\s*[}\]])", r"\1", body))
        except ValueError:
            return None
        return json.dumps({"skills": got} if isinstance(got, list) else got, ensure_ascii=False)

    return answer.map(one, na_action="ignore")
