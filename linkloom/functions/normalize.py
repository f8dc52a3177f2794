"""Stage 1: normalisation of business records, in native column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW = ["entity_id", "business_name", "business_address", "country"]

# What the data format counts as missing, and the rewrite rules in their order.
NA_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
NULL_WORDS = ["null", "none", "nan", "undefined"]
HONORIFIC = r"^(m\s*s|dr|mr|mrs|ms|shree|shri|prof)\s+"
LEGAL_REWRITES = [
    (r"\bpvt\s*ltd\b", "private limited"), (r"\bpty\s*ltd\b", "proprietary limited"), (r"\bltd\b", "limited"),
    (r"\binc\b", "incorporated"), (r"\bcorp\b", "corporation"), (r"\bllc\b", "limited liability company"),
    (r"\bllp\b", "limited liability partnership"), (r"\bplc\b", "public limited company"), (r"\bco\b", "company"),
    (r"\benterprises?\b", "enterprise"), (r"\bservices?\b", "service"),
]
ADDRESS_REWRITES = [
    (r"\brd\b", "road"), (r"\bst\b", "street"), (r"\bave\b", "avenue"), (r"\bblvd\b", "boulevard"), (r"\bdr\b", "drive"),
    (r"\bln\b", "lane"), (r"\bct\b", "court"), (r"\bpkwy\b", "parkway"), (r"\bhwy\b", "highway"), (r"\bapt\b", "apartment"),
    (r"\bste\b", "suite"), (r"\b(fl|flr)\b", "floor"), (r"\bbldg\b", "building"), (r"\b(hn|house\s*no)\b", "house"),
    (r"\bflat\s*no\b", "flat"), (r"\bplot\s*no\b", "plot"), (r"\bopp\b", "opposite"), (r"\bno\b", "number"),
]
LEGAL_WORDS = (
    "private pvt limited ltd incorporated inc corporation corp company co enterprise enterprises service services "
    "gmbh sarl sas sa llc llp plc pty group holdings holding associates consulting solutions technologies technology "
    "international global liability partners partnership industries industry ventures"
).split()
STOP_WORDS = "the and of in for at by to a an on with from as is or m/s dr mr mrs ms shri shree prof".split()
POSTAL_INDIA = r"(?U)\b([1-9][0-9]{2}\s?[0-9]{3})\b"
POSTAL_US_NEAR = r"(?iU)(?:[A-Z]{2}[,\s]+|,\s*|\bstate\s+)([0-9]{5}(?:-[0-9]{4})?)\b"
POSTAL_US_END = r"(?U)\b([0-9]{5}(?:-[0-9]{4})?)$"
POSTAL_FRANCE = r"(?U)\b((?:0[1-9]|[1-8]\d|9[0-8])\d{3})\b"


@cache
def fold_table() -> tuple[str, str, dict[str, str]]:
    """NFKD without what isn't ASCII: characters with one replacement, those replacements, and
    the characters with several."""
    single, to, several = [], [], {}
    for c in range(0x80, 0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        a = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if ord(x) < 128)
        if len(a) == 1:
            single.append(chr(c))
            to.append(a)
        elif a:
            several[chr(c)] = a
    return "".join(single), "".join(to), several


def strip(c: Column) -> Column:
    """Without white space of any script at the ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def to_ascii(c: Column) -> Column:
    single, to, several = fold_table()
    any_of = "[" + "".join(several) + "]"
    names = F.create_map(*(F.lit(x) for kv in several.items() for x in kv))
    spread = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(names[ch], ch)), "")
    plain = F.when(c.rlike(any_of), spread).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(plain, single, to), r"[^\x00-\x7F]", "")).otherwise(c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def sanitize_text(c: Column) -> Column:
    s = strip(c)
    t = F.lower(to_ascii(s))
    t = F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    t = squeeze(F.regexp_replace(t, r"[^a-z0-9\s]", " "))
    return F.when(F.lower(s).isin(NULL_WORDS), "").otherwise(t)


def _rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def collapse_repeats(c: Column) -> Column:
    """Words without those that equal the one before."""
    # the words are bound once, as the element of an array
    kept = lambda w: F.array_join(F.filter(w, lambda x, i: (i == 0) | (x != F.get(w, i - 1))), " ")
    return F.get(F.transform(F.array(tokens(c)), kept), F.lit(0))


def clean_name(c: Column) -> Column:
    return collapse_repeats(_rewrite(F.regexp_replace(sanitize_text(c), HONORIFIC, ""), LEGAL_REWRITES))


def clean_address(c: Column) -> Column:
    bare = F.regexp_replace(sanitize_text(c), r"\b0+([1-9]\d*)\b", "$1")
    return collapse_repeats(_rewrite(bare, ADDRESS_REWRITES))


def postal_code(address: Column, country: Column) -> Column:
    a, land = strip(address), F.upper(strip(country))
    near = F.regexp_extract(a, POSTAL_US_NEAR, 1)
    us = F.when(near != "", near).otherwise(F.regexp_extract(a, POSTAL_US_END, 1))
    found = (
        F.when(land == "INDIA", F.replace(F.regexp_extract(a, POSTAL_INDIA, 1), F.lit(" "), F.lit("")))
        .when(land == "US", F.substring_index(us, "-", 1))
        .when(land == "FRANCE", F.regexp_extract(a, POSTAL_FRANCE, 1))
        .otherwise("")
    )
    return F.when(F.lower(a).isin(NULL_WORDS), "").otherwise(found)


def name_tokens(clean: Column) -> Column:
    """Informative words of a clean name, space-joined."""
    words = tokens(clean)
    kept = F.array_distinct(F.filter(words, lambda x: ~x.isin(STOP_WORDS + LEGAL_WORDS)))
    long = F.filter(kept, lambda x: F.length(x) > 1)
    return F.array_join(F.when(F.size(long) > 0, long).when(F.size(kept) > 0, kept).otherwise(F.array_distinct(words)), " ")


def normalize(df: DataFrame) -> DataFrame:
    """The six-column contract, all strings without nulls; other columns are dropped."""
    if missing := [c for c in RAW if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    na = lambda c: F.when(~F.col(c).cast("string").isin(NA_CELLS), F.col(c).cast("string"))
    d = df.withColumns({c: na(c) for c in RAW}).withColumn("_name", clean_name(F.col("business_name")))
    return d.select(
        strip(F.col("entity_id")).alias("entity_id"),
        F.col("_name").alias("business_name_clean"),
        clean_address(F.col("business_address")).alias("business_address_clean"),
        strip(F.col("country")).alias("country"),
        postal_code(F.col("business_address"), F.col("country")).alias("postal_code"),
        name_tokens(F.col("_name")).alias("name_tokens"),
        *(c for c in df.columns if c == "ord"),
    )


def soundex(c: Column) -> Column:
    """Soundex in which H and W separate letters as vowels do; no letters give an empty string."""
    letters = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(F.regexp_replace(letters, "(?<=.)[HW]", "A")))
