"""Normalisation of clinical values as columns: headers, dates, results, measurements, origins, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Synonyms of a result.
RESULTS = {"S": "S", "SUSCEPTIBLE": "S", "SENSITIVE": "S", "I": "I", "INTERMEDIATE": "I", "SDD": "I", "R": "R", "RESISTANT": "R"}


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def normal_header(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def parsed_date(value: Column, day_first: bool = True) -> Column:
    """ISO, then day/month/year (or month/day/year), then HL7 digits; null if none is a date of the calendar."""
    value = F.trim(value)
    slash = "d/M/yyyy" if day_first else "M/d/yyyy"
    return F.coalesce(F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.regexp_replace(value, "[.-]", "/"), slash), F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd"))


def interpretation(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in RESULTS.items() for x in pair])
    return known[F.upper(F.trim(value))]


def sex(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("m", "male"), "M").when(v.isin("f", "female"), "F")


def first_number(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def strict_number(value: Column) -> Column:
    """A number with an optional comparator and a point or comma; null for anything else."""
    v = F.regexp_replace(F.trim(value), ",", ".")
    return F.when(v.rlike(r"^(?:<=|>=|<|>|=)?\s*\d+(?:\.\d+)?$"), first_number(v))


def method(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.when(v.isin("MIC", "ETEST", "E"), "MIC").when(v.isin("DISK", "DISC", "ZONE", "D"), "DISK")


def interpreted(value: Column, test: Column, s: Column, r: Column) -> Column:
    """S, I or R of a measurement by breakpoints: low MICs and wide zones are susceptible; I takes both breakpoints."""
    mic = F.when(value <= s, "S").when(value > r, "R").when(s.isNotNull() & r.isNotNull(), "I")
    disk = F.when(value >= s, "S").when(value < r, "R").when(s.isNotNull() & r.isNotNull(), "I")
    return F.when(value.isNotNull() & (test == "MIC"), mic).when(value.isNotNull() & (test == "DISK"), disk)


def infection_origin(location_type: Column, admission: Column, specimen: Column) -> Column:
    """Outpatients: community. Inpatients: hospital if the specimen came more than two days after admission."""
    days, location_type = F.datediff(specimen, admission), F.lower(F.trim(location_type))
    known = (location_type == "in") & admission.isNotNull() & specimen.isNotNull()
    return F.when(location_type == "out", "Community").when(known, F.when(days > 2, "Hospital").otherwise("Community")).otherwise("Unknown")


def postal_code(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[\s-]", ""))


def reporting_year(day: Column, first_month: int) -> Column:
    return F.year(F.add_months(day, 1 - first_month))


def mmwr_week(day: Column) -> tuple[Column, Column]:
    """Year and week of Sunday-based weeks, where week 1 is the one with four days or more in January."""
    middle = F.date_add(day, 4 - F.dayofweek(day))
    return F.year(middle), F.floor((F.dayofyear(middle) - 1) / 7).cast("int") + 1


#: What is taken out of free text, in this order.
REDACTIONS = (
    (r"\b\d{4}-\d{2}-\d{2}\b", "[DATE]"),
    (r"\b(?:\+?\d{1,3}[-\s]?)?\(?\d{2,4}\)?[-\s]?\d{3,4}[-\s]?\d{3,4}\b", "[PHONE]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL]"),
    (r"\b[A-Z]{2,}\d{4,}\b", "[ID]"),
    (r"(?i)(?:patient(?:[_ ]?(?:id|name))?|first[_ ]?name|last[_ ]?name|mrn|uhid|specimen[_ ]?number|dob)\s*[:=]\s*[^,;\n}]+", "[IDENTIFIER]"),
)


def redacted(text: Column) -> Column:
    for pattern, label in REDACTIONS:
        text = F.regexp_replace(text, pattern, label)
    return text


#: Personal data in a text.
EMAIL, LONG_DIGITS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?:^|\D)\d{10,15}(?:\D|$)"


def holds_identifier(text: Column) -> Column:
    """An e-mail address or a run of 10 to 15 digits, in the text or in a copy with dates masked and separators gone."""
    joined = F.regexp_replace(F.regexp_replace(text, r"\d{4}-\d{2}-\d{2}", "DATE"), r"[ .()-]", "")
    return text.rlike(EMAIL) | text.rlike(LONG_DIGITS) | joined.rlike(LONG_DIGITS)


def spreadsheet_safe(text: Column) -> Column:
    """Text that a spreadsheet does not take for a formula."""
    formula = text.rlike(r"^[=+@]") | (text.startswith("-") & ~text.rlike(r"^-\d+(?:\.\d+)?$"))
    return F.when(formula, F.concat(F.lit("'"), text)).otherwise(text)


#: Phenotypes by subclass, then by class.
SUBCLASS_PHENOTYPES = (
    (r"carbapenems?", "carbapenem-R"), (r"cephalosporin\s*iii", "3GC-R"), (r"cephalosporin\s*iv", "4GC-R"), (r"cephamycin", "cephamycin-R"),
    (r"penicillin\s*\(stable\)", "oxacillin-R"), (r"(lipo)?glycopeptide", "glycopeptide-R"), (r"fluoroquinolone", "fluoroquinolone-R"),
)
CLASS_PHENOTYPES = (
    (r"aminoglycosides", "aminoglycoside-R"), (r"lipopeptides", "polymyxin-R"), (r"macrolides", "macrolide-R"), (r"tetracyclines", "tetracycline-R"),
    (r"folate pathway inhibitors", "folate-R"),
)


def phenotype(subclass: Column, family: Column, agent: Column) -> Column:
    """The resistance mechanism an agent stands for, by its whole subclass and then its whole class; else the agent itself."""
    found = [F.when(F.lower(F.trim(c)).rlike(f"^(?:{pattern})$"), label) for c, known in ((subclass, SUBCLASS_PHENOTYPES), (family, CLASS_PHENOTYPES)) for pattern, label in known]
    return F.coalesce(*found, agent)
