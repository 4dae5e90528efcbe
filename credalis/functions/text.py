"""Text, date and key expressions. All run in the JVM over whole columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalis.functions.seeded import key_hash

# Date vocabulary.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SEASONS = ("spring", "summer", "fall", "autumn", "winter")
PREPOSITIONS = ("by", "in", "on", "during", "throughout", "before", "after", "until", "since", "as of", "from", "through", "within", "at", "of", "between")
# Words that no person's name has.
NAME_STOPWORDS = (
    "League", "SK", "FC", "Club", "Team", "Education", "Missionaries", "Lutheran", "Home", "Dark", "Came", "Dance", "Princess",
    "Prince", "Archduchess", "Archduke", "King", "Queen", "Saint", "Sir", "Lady", "Statistics", "Ecclesiastical", "Living",
    "Church", "University", "Now", "The", "New", "Old", "Great", "Little", "Big", "Black", "White",
)
MARK = "\u0001"
"""Stands where a date has been, until the words that lead to it are gone too."""
YEAR_OFFSETS = (-6, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5, 6)
NUMBER_FACTORS = (0.5, 0.7, 0.8, 1.25, 1.5, 2.0, 3.0)
RESERVED_TOKENS = (
    "[P]", "[L]", "[C]", "[E]", "[R]", "[DESCRIPTION]", "[EXAMPLE]", "[OUTPUT]", "(", ")",
)
CHARS_PER_TOKEN = 1.5
UNICODE = "(?U)"
"""Makes Java's \\w, \\s, \\b and \\d follow Unicode."""


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, UNICODE + pattern, replacement)


def squeeze(c: Column | str) -> Column:
    """Collapse whitespace and trim."""
    return F.trim(_sub(_c(c), r"\s+", " "))


def normalise_answer(c: Column | str) -> Column:
    """Lower case, punctuation to space, single spaces."""
    return squeeze(_sub(F.lower(_c(c)), r"[^\p{L}\p{N}_\s]", " "))


def parse_yes_no(c: Column | str) -> Column:
    """``yes`` / ``no`` after trimming stars, dots and blanks; otherwise null."""
    s = F.lower(F.trim(_c(c), F.lit(" *\n.")))
    return F.when(s.isin("yes", "no"), s)


def parse_option_index(c: Column | str) -> Column:
    """Index 0..3 from a single digit or letter; otherwise null."""
    s = squeeze(c)
    return (
        F.when(s.rlike("^[0-3]$"), s.cast("int"))
        .when(s.rlike("^[A-Da-d]$"), F.ascii(F.upper(s)) - F.ascii(F.lit("A")))
    )


def annotation_label(kinds: Column | str) -> Column:
    """``single``, ``ambiguous`` or ``mixed`` from a set of annotation types."""
    u = F.array_distinct(_c(kinds))
    only = F.size(u) == 1
    return (
        F.when(only & F.array_contains(u, "singleAnswer"), "single")
        .when(only & F.array_contains(u, "multipleQAs"), "ambiguous")
        .otherwise("mixed")
    )


def title_case(c: Column | str) -> Column:
    """Capitalise every run of letters (also after an apostrophe or a dash)."""
    runs = F.regexp_extract_all(_c(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
        ),
        "",
    )


def display_case(c: Column | str) -> Column:
    """Trim, drop final dots; all-capital answers longer than 4 become title case."""
    a = F.rtrim(F.trim(_c(c)), F.lit("."))
    shouting = (a == F.upper(a)) & (a != F.lower(a)) & (F.length(a) > 4)
    return F.when(shouting, title_case(a)).otherwise(a)


def _any(words: tuple[str, ...] | list[str]) -> str:
    """One of some words, blanks in them of any length."""
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


def _calendar_run() -> str:
    """Neighbouring calendar words: months with days, weekdays, years, seasons of a year."""
    year = r"\b(?:19|20)\d\d\b"
    day = r"\d{1,2}(?:st|nd|rd|th)?"
    short = [m[:3] for m in MONTHS if len(m) > 3] + ["Sept"]
    month = rf"(?:\b{_any(MONTHS)}\b(?!\s+of\s+Dimes)|\b{_any(short)}\.)"
    month_and_day = rf"(?:\b{day}\s+)?{month}(?:\s*{day}\b(?:\s*(?:-|–|to)\s*{day}\b)?)?"
    season = rf"\b(?i:{_any(SEASONS)})(?=,?\s+{year})"
    word = rf"(?:{month_and_day}|\b{_any(WEEKDAYS)}\b|{season}|{year})"
    return rf"{word}(?:,?\s+{word})*"


def mask_dates(c: Column | str) -> Column:
    """Remove dates and the words that only lead to them; tidy and capitalise.

    Dates become marks first. Then a mark takes in what stands before it: a span such as
    "the end of" or "early", prepositions, and the first half of "between .. and ..".
    """
    part = rf"(?:{_any(['early', 'mid', 'late'])}[-\s]*|(?:the\s+)?(?:{_any(['first', 'second', 'third', 'last', 'trading'])}\s+)?{_any(['start', 'beginning', 'middle', 'end', 'half', 'week'])}\s+(?:of|ending)\s*|the\s+)"
    out = _sub(_c(c), _calendar_run(), MARK)
    for _ in range(2):
        out = _sub(out, rf"(?i)\b{part}{MARK}", MARK)
        out = _sub(out, rf"(?i)\b{_any(PREPOSITIONS)}\s+{MARK}", MARK)
        out = _sub(out, rf"(?i){MARK}\s*(?:and|to|through|or|-|–)\s*{MARK}", MARK)
    out = squeeze(F.replace(out, F.lit(MARK), F.lit(" ")))
    out = _sub(_sub(out, r"[\s,]+([?.])", "$1"), r"(\s+,)+|,(?:\s*,)+", ",")
    out = _sub(out, r"^[\s,]+", "")
    return F.concat(F.upper(F.substring(out, 1, 1)), out.substr(F.lit(2), F.length(out)))


def month_number(name: Column) -> Column:
    """1..12 from an English month name; null otherwise."""
    months = F.array(*[F.lit(m.lower()) for m in MONTHS])
    pos = F.array_position(months, F.lower(name))
    return F.when(pos > 0, pos)


def _dated_words(c: Column, edge: str) -> Column:
    """(year, word before) of every year in a text, word by word.

    Only a year that begins its word has a word before it, and a day number between them is
    passed over. ``edge`` is what stands on both sides of a year.
    """
    words = F.split(F.trim(c), rf"{UNICODE}\s+")
    century = r"(?:19|20)\d\d"

    def before(i: Column) -> Column:
        one, two = F.get(words, i - 1), F.get(words, i - 2)
        return F.regexp_extract(F.when(one.rlike(rf"{UNICODE}^\d{{1,2}},?$"), two).otherwise(one), rf"{UNICODE}{edge}(\p{{L}}+)$", 1)

    def years(word: Column, i: Column) -> Column:
        found = F.regexp_extract_all(word, F.lit(rf"{UNICODE}{edge}({century}){edge}"), F.lit(1))
        name = F.when(word.rlike(rf"{UNICODE}^{century}{edge}"), before(i))
        return F.transform(found, lambda y, k: F.struct(y.alias("year"), F.when(k == 0, name).alias("name")))

    return F.flatten(F.transform(words, years))


def latest_date(c: Column | str) -> Column:
    """Latest year (plus month fraction) mentioned; null without a year."""
    when = F.transform(_dated_words(_c(c), ""), lambda m: m["year"].cast("double") + (F.coalesce(month_number(m["name"]), F.lit(1)) - 1) / F.lit(12.0))
    return F.array_max(when)


def settled_by(question: Column | str, month: Column | str) -> Column:
    """Latest ``YYYY-MM`` mentioned, a bare year counting as December, at least ``month``."""
    last = F.transform(
        _dated_words(_c(question), r"\b"),
        lambda m: F.concat(m["year"], F.lit("-"), F.lpad(F.coalesce(month_number(m["name"]), F.lit(12)).cast("string"), 2, "0")),
    )
    return F.greatest(_c(month), F.array_max(last))


def month_after_end(month: Column | str) -> Column:
    """Last day of the month after ``YYYY-MM``, as ``YYYY-MM-DD``."""
    first = F.to_date(F.concat(_c(month), F.lit("-01")))
    return F.date_format(F.last_day(F.add_months(first, 1)), "yyyy-MM-dd")


def years_since(month: Column | str, base: int = 2020) -> Column:
    """Years from January of ``base`` to ``YYYY-MM``."""
    m = _c(month)
    return (
        F.substring(m, 1, 4).cast("int") - base
        + (F.substring(m, 6, 2).cast("int") - 1) / F.lit(12.0)
    )


def words_in(c: Column) -> Column:
    """Whitespace-separated words of a string; null counts 0."""
    parts = F.split(F.trim(_sub(c, r"\s+", " ")), " ")
    return F.coalesce(F.size(F.filter(parts, lambda x: x != "")), F.lit(0))


def word_count(c: Column, dtype: T.DataType) -> Column:
    """Words over every string nested in a struct, array or map column."""
    if isinstance(dtype, T.StringType):
        return words_in(c)
    if isinstance(dtype, T.StructType):
        out = F.lit(0)
        for f in dtype.fields:
            out = out + word_count(c[f.name], f.dataType)
        return out
    if isinstance(dtype, T.ArrayType):
        add = F.aggregate(c, F.lit(0), lambda a, x: a + word_count(x, dtype.elementType))
        return F.coalesce(add, F.lit(0))
    if isinstance(dtype, T.MapType):
        return word_count(F.map_values(c), T.ArrayType(dtype.valueType))
    return F.lit(0)


def is_person_name(c: Column | str) -> Column:
    """Two or three capitalised alphabetic words, none of them a stop word."""
    toks = F.split(squeeze(c), " ")
    capital = F.forall(toks, lambda t: t.rlike(r"^\p{Lu}[\p{L}-]*$"))
    stop = F.array(*[F.lit(w) for w in NAME_STOPWORDS])
    return F.size(toks).between(2, 3) & capital & ~F.arrays_overlap(toks, stop)


def _shuffled(values: tuple, seed: str, key: Column) -> Column:
    """A fixed tuple in seeded order."""
    items = F.array(
        *[F.struct(key_hash(seed, key, F.lit(str(v))).alias("h"), F.lit(v).alias("v")) for v in values]
    )
    return F.transform(F.array_sort(items), lambda s: s["v"])


def perturb_answers(c: Column | str, k: int = 3, seed: str = "perturb") -> Column:
    """``k`` distinct numeric variants of an answer: shifted year, else scaled number."""
    c = _c(c)
    year_re = r"^([\s\S]*?)\b(1[0-9]{3}|20[0-9]{2})\b([\s\S]*)$"
    num_re = r"^([\s\S]*?)(\d[\d,]*(?:\.\d+)?)([\s\S]*)$"
    year = F.regexp_extract(c, year_re, 2)
    offsets = F.slice(_shuffled(YEAR_OFFSETS, seed, c), 1, k)
    by_year = F.transform(
        offsets,
        lambda o: F.concat(
            F.regexp_extract(c, year_re, 1), (year.cast("int") + o).cast("string"),
            F.regexp_extract(c, year_re, 3),
        ),
    )
    raw = F.regexp_extract(c, num_re, 2)
    value = F.regexp_replace(raw, ",", "").cast("double")
    decimals = F.length(F.regexp_extract(raw, r"\.(\d+)$", 1))
    factors = F.slice(_shuffled(NUMBER_FACTORS, seed, c), 1, k)

    def scaled(f: Column) -> Column:
        whole = F.bround(value * f, 0).cast("long")
        whole = F.when(whole == value.cast("long"), whole + 1).otherwise(whole)
        grouped = F.when(F.contains(raw, F.lit(",")), F.format_number(whole, 0)).otherwise(whole.cast("string"))
        # decimals is data-dependent, so round exactly and pad the fraction
        frac = F.call_function("format_string", F.concat(F.lit("%."), decimals.cast("string"), F.lit("f")), value * f)
        return F.concat(
            F.regexp_extract(c, num_re, 1), F.when(decimals == 0, grouped).otherwise(frac),
            F.regexp_extract(c, num_re, 3),
        )

    by_number = F.transform(factors, scaled)
    picked = F.when(year != "", by_year).when(raw != "", by_number)
    return F.when(F.size(F.array_distinct(picked)) == k, picked)


def strip_condition(unit: Column | str, prefix: str = "cutoff") -> Column:
    """Drop ``<prefix>:<condition>:`` from a unit id."""
    return F.regexp_replace(_c(unit), rf"^{prefix}:[a-z_]+:", "")


def unit_key(dataset: Column, outside: Column, index: Column) -> Column:
    """``<dataset>:in|oos:<index>``."""
    return F.concat_ws(":", dataset, F.when(outside, "oos").otherwise("in"), index.cast("string"))


def seed_key(key: Column | str, seed: str) -> Column:
    """Insert a seed string after the data set part of a key."""
    return F.regexp_replace(_c(key), "^([^:]*):", f"$1:{seed}:")


def normalise_key(key: Column | str, seed: str) -> Column:
    """Inverse of :func:`seed_key`; other keys stay."""
    return F.regexp_replace(_c(key), f"^([^:]*):{seed}:([^:]*):([^:]*)$", "$1:$2:$3")


def evaluation_id(key: Column | str) -> Column:
    """``test:<index>`` or ``oos:<index>`` from an item key."""
    key = _c(key)
    kind = F.element_at(F.split(key, ":"), -2)
    return F.concat_ws(":", F.when(kind == "in", "test").otherwise("oos"), F.element_at(F.split(key, ":"), -1))


def estimate_tokens(request_json: Column | str) -> Column:
    """Tokens of a request from its ASCII-escaped JSON length."""
    escaped = F.regexp_replace(_c(request_json), r"[\x{10000}-\x{10FFFF}]", "............")
    escaped = F.regexp_replace(escaped, r"[^\x00-\x7F]", "......")
    return F.ceil(F.length(escaped) / F.lit(CHARS_PER_TOKEN)).cast("long")


def sanitise_text(c: Column | str) -> Column:
    """Replace reserved tokens by blanks and collapse whitespace."""
    out = _c(c)
    for t in RESERVED_TOKENS:
        out = F.replace(out, F.lit(t), F.lit(" "))
    return squeeze(out)


def char_ngrams(c: Column | str, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside blank-padded words, lower case.

    A padded word shorter than ``n`` gives itself once and no longer grams.
    """
    words = F.filter(F.split(squeeze(F.lower(_c(c))), " "), lambda w: w != "")

    def grams(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        n = F.length(p)

        def of(k: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
            made = F.transform(starts, lambda s: p.substr(s, F.lit(k)))
            # shorter words were already emitted whole at the previous size
            return made if k == low else F.when(n >= k, made).otherwise(F.array().cast("array<string>"))

        return F.concat(*[of(k) for k in range(low, high + 1)])

    return F.flatten(F.transform(words, grams))
