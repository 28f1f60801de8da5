"""Names and identifiers in comparable form. Patterns use only classes that mean the same in Java, Python and RE2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Legal suffixes, in the order in which they are tried.
LEGAL_SUFFIXES = (
    r"private\s+limited", r"pvt\.?\s*ltd\.?", r"pvt\.?", r"p\.?\s*ltd\.?",
    r"public\s+limited", r"limited", r"ltd\.?", r"llp", r"llc", r"l\.?l\.?c\.?",
    r"inc\.?", r"incorporated", r"corp\.?", r"corporation", r"company", r"co\.?",
    r"gmbh", r"s\.?a\.?", r"b\.?v\.?", r"pte\.?\s*ltd\.?", r"pte\.?",
    r"and\s+sons", r"& sons", r"enterprises", r"ventures",
)
# Words that tell little about a company.
LOW_INFORMATION = (
    "technologies", "technology", "tech", "solutions", "systems", "services",
    "software", "digital", "global", "india", "group", "holdings", "international",
    "consulting", "labs", "media", "networks", "industries", "trading",
)
# Domains of free mail.
FREE_MAIL = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "outlook.com",
    "hotmail.com", "live.com", "icloud.com", "me.com", "aol.com", "protonmail.com",
    "rediffmail.com", "zoho.com", "mail.com", "yandex.com", "gmx.com",
)
# Words of addresses and their short forms.
ADDRESS_WORDS = {
    "road": "rd", "street": "st", "avenue": "ave", "floor": "flr", "building": "bldg", "block": "blk",
    "sector": "sec", "plot": "plt", "nagar": "ngr", "opposite": "opp", "near": "nr",
}
# Parts of a contract's file name that aren't the customer.
FILE_MARKS = r"(?i)_(MSA|Agreement|Contract|SOW|Amendment|Subscription|Services|Annual|Scanned)(_\d+)?|_\d{4}|_FY\d{4}"
GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"
PAN = "^[A-Z]{5}[0-9]{4}[A-Z]$"
SUFFIX = r"\b(" + "|".join(LEGAL_SUFFIXES) + r")\b\.?"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 \t\n]", " "), "[ \t\n]+", " "))


def normalize_name(name: Column) -> Column:
    """STR1: lower case, without legal suffixes and signs. All trailing suffixes go first, in one expression; those that are left further in go, too."""
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    text = F.regexp_replace(text, r"[.,'\"()\[\]]", " ")
    text = F.regexp_replace(text, "[&/]", " and ")
    trimmed = F.trim(F.regexp_replace(text, rf"(?:{SUFFIX}\s*)+$", ""))
    return _squeezed(F.regexp_replace(trimmed, SUFFIX, " "))


def name_tokens(name: Column) -> Column:
    """STR2: sorted distinctive words, or all of them if none is distinctive."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(normalize_name(name), " "), lambda w: F.length(w) > 1)))
    telling = F.array_except(words, F.array(*map(F.lit, LOW_INFORMATION)))
    return F.when(F.size(telling) > 0, telling).otherwise(words)


def normalize_domain(value: Column) -> Column:
    """STR3: domain of an address, URL or name; null if it tells nothing."""
    text = F.lower(F.trim(value))
    text = F.when(F.contains(text, F.lit("@")), F.element_at(F.split(text, "@"), -1)).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, "^https?://", ""), r"^www\.", "")
    text = F.trim(F.regexp_extract(text, "^[^/:]*", 0))
    return F.when(F.contains(text, F.lit(".")) & ~text.isin(*FREE_MAIL), text)


def normalize_email(value: Column) -> Column:
    """STR4: lower case, without +tags; dots don't count at Google."""
    text = F.lower(F.trim(value))
    local, domain = F.substring_index(text, "@", 1), F.regexp_extract(text, "^[^@]*@(.*)$", 1)
    local = F.substring_index(local, "+", 1)
    local = F.when(domain.isin("gmail.com", "googlemail.com"), F.regexp_replace(local, r"\.", "")).otherwise(local)
    return F.when(F.contains(text, F.lit("@")) & (local != "") & (domain != ""), F.concat(local, F.lit("@"), domain))


def normalize_phone(value: Column) -> Column:
    """STR5: the last ten digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def normalize_tax_id(value: Column) -> Column:
    out = F.regexp_replace(F.upper(F.trim(value)), "[^A-Z0-9]", "")
    return F.when(out != "", out)


def pan_of(gstin: Column) -> Column:
    """STR6: the PAN inside a valid GSTIN."""
    tax = normalize_tax_id(gstin)
    pan = F.substring(tax, 3, 10)
    return F.when(tax.rlike(GSTIN) & pan.rlike(PAN), pan)


def normalize_address(value: Column) -> Column:
    """STR7"""
    text = F.lower(F.coalesce(value, F.lit("")))
    for word, short in ADDRESS_WORDS.items():
        text = F.regexp_replace(text, rf"\b{word}\b", short)
    return _squeezed(text)


def postal_code(value: Column) -> Column:
    found = F.regexp_extract(value, r"\b([1-9][0-9]{5})\b", 1)
    return F.when(found != "", found)


def ngrams(name: Column, n: int = 4) -> Column:
    """STR8: distinct n-grams of a normalised name without spaces."""
    flat = F.regexp_replace(name, " ", "")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - n + 1, F.lit(1))), lambda i: F.substr(flat, i, F.lit(n)))
    return F.array_distinct(F.filter(many, lambda g: g != ""))


def account_fingerprint(workspace: Column, account: Column) -> Column:
    """PRJ16"""
    return F.sha2(F.concat_ws(":", workspace.cast("string"), F.regexp_replace(F.upper(account), "[^A-Z0-9]", "")), 256)


def name_from_filename(name: Column) -> Column:
    """STR17: the customer that a contract's file name tells of: without extension, kind of document and year."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, FILE_MARKS, " ")
    return F.trim(F.regexp_replace(stem, "[_-]+", " "))
