"""Column functions: normalisation, checksums, dates, names, masks. Each takes and returns Columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of IBANs by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "MX": 18, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PT": 25, "QA": 29, "RO": 24, "SA": 24, "SE": 24, "SG": 19, "SI": 19, "SK": 24, "TN": 24, "TR": 26,
}
# Country names and three-letter codes that are understood.
COUNTRY_NAMES = {
    "brazil": "BR", "brasil": "BR", "chile": "CL", "colombia": "CO", "canada": "CA", "united states": "US", "usa": "US",
    "united states of america": "US", "u.s.": "US", "germany": "DE", "deutschland": "DE", "italy": "IT", "italia": "IT", "france": "FR",
    "netherlands": "NL", "nederland": "NL", "the netherlands": "NL", "holland": "NL", "switzerland": "CH", "schweiz": "CH", "suisse": "CH",
    "japan": "JP", "korea": "KR", "south korea": "KR", "republic of korea": "KR", "china": "CN", "spain": "ES", "españa": "ES",
    "united kingdom": "GB", "uk": "GB", "great britain": "GB", "austria": "AT", "poland": "PL", "belgium": "BE", "finland": "FI",
    "norway": "NO", "sweden": "SE", "ireland": "IE", "portugal": "PT", "denmark": "DK", "singapore": "SG", "hong kong": "HK",
    "malaysia": "MY", "united arab emirates": "AE", "uae": "AE", "mexico": "MX", "argentina": "AR", "india": "IN",
}
ISO3 = {
    "COL": "CO", "USA": "US", "DEU": "DE", "CHN": "CN", "GBR": "GB", "ESP": "ES", "MEX": "MX", "BRA": "BR", "CHL": "CL", "CAN": "CA",
    "FRA": "FR", "ITA": "IT", "NLD": "NL", "CHE": "CH", "JPN": "JP", "KOR": "KR", "SGP": "SG", "ARE": "AE", "AUT": "AT", "PRT": "PT",
}
# Tokens of legal forms and titles that do not say who a name means.
LEGAL_TOKENS = (
    "ltd limited llc inc incorporated corp corporation co company gmbh ag kg ug ohg eood ood sas sa srl sarl sl spa bv nv plc pty oy ab as "
    "aps kft zrt sro doo dr md m d prof jr sr"
).split()
# Words that mark a business name.
BUSINESS_WORD = r"(?i)\b(llc|l\.l\.c|inc|incorporated|corp|corporation|ltd|limited|gmbh|s\.?a\.?s?|pllc|llp|company|co\.)\b"
# Date formats in the order in which they are tried, and month names of other languages.
DATE_FORMATS = (
    "d.M.yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy-M-d", "d-M-yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "M/d/yy", "d.M.yy",
    "d MMM yyyy", "d MMM, yyyy", "d MMMM, yyyy", "MMMM d yyyy", "MMM d yyyy",
)
MONTHS = {
    "enero": "January", "febrero": "February", "marzo": "March", "abril": "April", "mayo": "May", "junio": "June", "julio": "July",
    "agosto": "August", "septiembre": "September", "octubre": "October", "noviembre": "November", "diciembre": "December",
    "januar": "January", "februar": "February", "märz": "March", "mai": "May", "juni": "June", "juli": "July", "oktober": "October",
    "dezember": "December",
}
VERDICTS = ("ACCEPT", "WARNING", "NEED_MANUAL_REVIEW", "REJECT")
TAX_KINDS = ("ssn", "ein", "tin")


def _literal(x: object) -> str:
    """A text or whole number as SQL."""
    return f"'{x.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'" if isinstance(x, str) else str(int(x))


def texts(*values: str) -> Column:
    """An array of literals, made in one step: many calls into the JVM cost more than what they describe."""
    return F.expr(f"array({', '.join(map(_literal, values))})")


def lookup(table: dict[str, object], key: Column) -> Column:
    """table[key] as a map literal; null for other keys."""
    return F.try_element_at(F.expr(f"map({', '.join(map(_literal, chain.from_iterable(table.items())))})"), key)


def text_of(c: Column) -> Column:
    """Trimmed text; null counts as empty."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def blank(c: Column) -> Column:
    return text_of(c) == ""


def digits_of(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def norm_id(c: Column) -> Column:
    """Without white space, hyphens and dots, in capitals."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-.]", ""))


def norm_name(c: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(norm_name(c), " "), lambda t: t != "")


def lenient_tokens(c: Column) -> Column:
    """Tokens without legal forms and titles, in order."""
    legal = texts(*LEGAL_TOKENS)
    return F.filter(tokens(c), lambda t: ~F.array_contains(legal, t))


def norm_name_lenient(c: Column) -> Column:
    return F.array_join(lenient_tokens(c), " ")


def names_materially_equal(a: Column, b: Column) -> Column:
    """Equal without legal forms, or one's tokens within the other's with a shared one of three letters."""
    x, y = lenient_tokens(a), lenient_tokens(b)
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    core = F.exists(F.array_intersect(x, y), lambda t: F.length(t) >= 3)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.array_join(x, " ") == F.array_join(y, " ")) | (within & core))


def looks_like_business(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(BUSINESS_WORD)


def looks_like_person(c: Column) -> Column:
    """First [M.] Last, without digits, linking words or business words."""
    n = text_of(c)
    linked = F.concat(F.lit(" "), F.lower(n), F.lit(" ")).rlike(" (of|the|and|&|for) ")
    return n.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z]+){1,2}$") & ~linked & ~looks_like_business(n)


def norm_classification(c: Column) -> Column:
    """One of seven tax classes, '' where nothing is given; the first that matches wins."""
    v = F.lower(text_of(c))
    return (
        F.when(v.rlike("individual|sole"), "individual_sole_prop")
        .when(v.rlike("llc|limited liability"), "llc")
        .when(v.contains("partnership"), "partnership")
        .when(v.contains("corporation") | v.isin("c corp", "s corp"), "corporation")
        .when(v.rlike("trust|estate"), "trust_estate")
        .when(v != "", "other")
        .otherwise("")
    )


def to_iso2(c: Column) -> Column:
    """Two-letter country of a name or code, '' where unknown."""
    v = text_of(c)
    up = F.upper(v)
    known = texts(*sorted(set(COUNTRY_NAMES.values())))
    return F.coalesce(
        lookup(COUNTRY_NAMES, F.lower(v)),
        F.when((F.length(up) == 2) & F.array_contains(known, up), up),
        lookup(ISO3, up),
        F.when((F.length(up) > 2) & F.array_contains(known, F.substring(up, 1, 2)) & ~F.substring(up, 3, 1).rlike(r"\p{L}"), F.substring(up, 1, 2)),
        F.lit(""),
    )


def mod97(c: Column) -> Column:
    """A string of digits and capitals read as an ISO 7064 number, modulo 97."""
    value = lambda ch: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1
    return F.aggregate(
        F.filter(F.split(c, ""), lambda ch: ch != ""),
        F.lit(0),
        lambda acc, ch: (acc * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97,
    )


def iban_mod97_ok(c: Column) -> Column:
    s = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    shaped = s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$")
    # without letters behind the country it is one number of up to 36 digits
    behind = F.substr(s, F.lit(5))
    number = F.concat(behind, F.ascii(s) - 55, F.ascii(F.substring(s, 2, 1)) - 55, F.substring(s, 3, 2)).try_cast("decimal(38,0)")
    return shaped & F.when(behind.rlike("^[0-9]+$"), number % 97 == 1).otherwise(mod97(F.concat(behind, F.substring(s, 1, 4))) == 1)


def iban_check_digits(country: Column, bban: Column) -> Column:
    """The two check digits that make country + digits + bban valid."""
    return F.lpad((F.lit(98) - mod97(F.concat(F.upper(bban), F.upper(country), F.lit("00")))).cast("string"), 2, "0")


def break_checksum(iban: Column) -> Column:
    """The IBAN with its last digit raised by one, modulo ten, which is never valid again."""
    last = F.substr(iban, F.length(iban))
    return F.concat(F.substr(iban, F.lit(1), F.length(iban) - 1), ((last.try_cast("int") + 1) % 10).cast("string"))


def aba_checksum_ok(c: Column) -> Column:
    """Weights 3, 7, 1 over nine digits give a multiple of ten."""
    d = text_of(c)
    weighted = sum((F.coalesce(F.substring(d, k + 1, 1).try_cast("int"), F.lit(0)) * (3, 7, 1)[k % 3] for k in range(9)), F.lit(0))
    return d.rlike("^[0-9]{9}$") & (weighted % 10 == 0)


def parse_bic(c: Column) -> Column:
    """Struct bank, country, location, branch, head_office; null where the shape is wrong."""
    v, shape = norm_id(c), r"^([A-Z]{4})([A-Z]{2})([A-Z0-9]{2})([A-Z0-9]{3})?$"
    part = lambda k: F.regexp_extract(v, shape, k)
    return F.when(
        v.rlike(shape),
        F.struct(
            part(1).alias("bank"), part(2).alias("country"), part(3).alias("location"), part(4).alias("branch"),
            part(4).isin("", "XXX").alias("head_office"),
        ),
    )


def parse_date(c: Column) -> Column:
    """The date a text says, by the first format that fits; else the middle of a year it names."""
    said = text_of(c)
    month = rf"(?i)(?<!\p{{L}})({'|'.join(MONTHS)})(?!\p{{L}})"
    english = lookup(MONTHS, F.lower(F.regexp_extract(said, month, 1)))
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, month, english), r"(?i)\bde\b", " "), r"\s+", " ")
    v = F.coalesce(F.trim(named), said)  # null without a month of another language
    year = F.regexp_extract(v, r"(20[0-9]{2})", 1).try_cast("int")
    # a format is tried only on what is shaped like it, as every failure costs an exception
    shaped = {mark: v.rlike(rf"^\d+\{mark}\d+\{mark}\d+$") for mark in "./-"} | {" ": v.rlike(r"\p{L}") & v.rlike(r"\d")}
    tries = (F.when(shaped[" " if "MMM" in f else next(c for c in f if c in "./-")], F.try_to_timestamp(v, F.lit(f)).cast("date")) for f in DATE_FORMATS)
    return F.coalesce(*tries, F.make_date(year, F.lit(7), F.lit(1)))


def first_diff(a: Column, b: Column) -> Column:
    """1-based position of the first difference; one past the shorter if it is a beginning of the other; null if equal."""
    n = F.least(F.length(a), F.length(b))
    spots = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & (F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1))))
    return F.when(a == b, None).otherwise(F.coalesce(F.array_min(spots), n + 1))


def verdict_rank(c: Column) -> Column:
    """0 ACCEPT to 3 REJECT; a crash counts as manual review; null for other values."""
    return lookup({v: k for k, v in enumerate(VERDICTS)} | {"CRASH": 2}, c)


def verdict_of(rank: Column) -> Column:
    return F.element_at(texts(*VERDICTS), rank + 1)


def verdict_direction(pred: Column, gold: Column) -> Column:
    """unsafe: softer than gold; safe: stricter; '' where equal."""
    p, g = verdict_rank(pred), verdict_rank(gold)
    return F.when(p < g, "unsafe").when(p > g, "safe").otherwise("")


def shape_key(doc_class: Column, has_text: Column, flags: list[Column], effort: Column) -> Column:
    """What runs that take equally long share."""
    return F.concat_ws("|", doc_class, F.when(has_text, "text").otherwise("scan"), *flags, F.when(effort != 3, F.concat(F.lit("e"), effort.cast("string"))))


def is_org_name(name: Column, classification: Column) -> Column:
    c = norm_classification(classification)
    return looks_like_business(name) | ~c.isin("", "individual_sole_prop") | F.lower(text_of(name)).rlike(
        r"\b(university|hospital|foundation|association|institute|clinic|group|services|bank)\b"
    )


def last4(c: Column) -> Column:
    return F.right(digits_of(c), F.lit(4))


def mask_value(kind: Column, value: Column) -> Column:
    """What may be shown of a sensitive value of this kind."""
    v, d = text_of(value), digits_of(value)
    n, tail = F.length(d), last4(value)
    enough = n >= 4
    ssn = F.when(enough, F.concat(F.lit("XXX-XX-"), tail)).otherwise("XXX-XX-????")
    ein = F.when(enough, F.concat(F.lit("XX-XXX"), tail)).otherwise("XX-XXX????")
    stars = F.when(n >= 5, F.concat(F.repeat(F.lit("*"), F.greatest(n - 4, F.lit(2))), tail)).otherwise("****")
    solid = F.upper(F.regexp_replace(v, r"\s", ""))
    iban = F.concat(F.substring(solid, 1, 2), F.lit("**…"), F.when(F.length(solid) >= 8, F.right(solid, F.lit(4))).otherwise(""))
    return (
        F.when(v == "", "")
        .when((kind == "ssn") | ((kind == "tin") & v.rlike(r"^\d{3}-\d{2}-\d{4}$")), ssn)
        .when((kind == "ein") | ((kind == "tin") & v.rlike(r"^\d{2}-\d{7}$")), ein)
        .when(kind == "iban", iban)
        .when(kind.isin("account_number", "routing_aba"), F.concat(F.lit("…"), F.when(enough, tail).otherwise(d)))
        .otherwise(stars)
    )


def display_value(kind: Column, value: Column, policy: str) -> Column:
    """Tax numbers masked whatever the policy; bank values in full only under 'full'."""
    return F.when(kind.isin(*TAX_KINDS) | F.lit(policy != "full"), mask_value(kind, value)).otherwise(text_of(value))


def fake_preserve_shape(kind: Column, value: Column, seed: str) -> Column:
    """Other digits in the same places, the same ones at every run."""
    v = text_of(value)
    stream = F.sha2(F.concat_ws("|", F.lit(seed), kind, v).cast("binary"), 256)
    digit = lambda k: (F.instr(F.lit("0123456789abcdef"), F.substr(stream, k % 64 + 1, F.lit(1))) - 1) % 10
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    return F.aggregate(
        F.filter(F.split(v, ""), lambda c: c != ""),
        start,
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc.s, digit(acc.k).cast("string")).alias("s"), (acc.k + 1).alias("k"))).otherwise(
            F.struct(F.concat(acc.s, c).alias("s"), acc.k.alias("k"))
        ),
        lambda acc: acc.s,
    )


def normalise_tags(c: Column) -> Column:
    """Snake case, each once, in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda t: F.trim(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", "_"), F.lit("_"))), lambda t: t != ""))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval at z = 1.96, three decimals; 0 and 0 without cases."""
    z2 = 1.96 * 1.96
    m = n.cast("double")
    p = hits / F.nullif(m, F.lit(0.0))
    mid, spread = (p + z2 / (2 * m)) / (1 + z2 / m), 1.96 / (1 + z2 / m) * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    return (
        F.coalesce(F.round(F.greatest(F.lit(0.0), mid - spread), 3), F.lit(0.0)),
        F.coalesce(F.round(F.least(F.lit(1.0), mid + spread), 3), F.lit(0.0)),
    )
