"""Personal data replaced by surrogates, with built-in column functions only.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment card numbers (16
digits, Luhn-valid), IBAN-like account numbers, social security numbers, secrets after a
name such as ``token = "..."``, and names after a form of address.

An entity is its kind and its text in a normal form, so that spellings of one e-mail
address or one number are one entity. Its surrogate is drawn from a keyed hash of kind,
normal form and attempt: the same everywhere for one entity, and of its kind, gender,
script and format (letters become letters of the same case, digits digits, a card number
stays Luhn-valid, an address an address, punctuation stays). Entities with the same
surrogate, or whose surrogate is an entity of the data, draw again but the first, until
there are none; so different entities never become one. Names, e-mail addresses and secrets
grow after a few attempts.

Nulls: a null text stays null and has no entities, as has an empty one. Texts without
entities stay as they are, to the byte.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tables import stored

KEY = "quillgrid"
#: Attempts at a free surrogate. Only numbers have formats that can't grow; if one of those is
#: full, the job stops instead of merging entities.
ATTEMPTS = 40
#: Attempts in an entity's own format; each further one makes a name, an address or a secret longer
#: by a syllable or letter, so that there is room for any number of them.
GROWS = 3

# Forms of address, and given names to draw from, by language and gender.
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Don"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Doña"]
OTHER_TITLES = ["Dr", "Prof"]
MALE_NAMES = ["Adrian", "Bruno", "Carl", "David", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Julian", "Karl", "Leon",
              "Martin", "Nathan", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"]
FEMALE_NAMES = ["Alice", "Bianca", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Laura",
                "Maria", "Nina", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Ursula", "Vera"]
SYLLABLES = ["bel", "dor", "fen", "gar", "hol", "jan", "kel", "lor", "mar", "nor", "pel", "ras", "sal", "tan", "ver", "wil"]
SECRET_NAMES = ["token", "api_key", "apikey", "secret", "password", "passwd", "access_key"]

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9\-])"
SECRET = r"(?i:\b(?:" + "|".join(SECRET_NAMES) + r"))\s*[=:]\s*[\"']?[A-Za-z0-9+/_\-]{12,}[\"']?"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"
CARD = r"(?<![\p{L}\d.])(?:\d{16}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4})(?![\d.]\d|\d)"
#: Leading digits of issued cards of 16 digits.
ISSUED = "^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|35|6011|64[4-9]|65)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\p{L}\p{N}.\-])(?:\+\d{1,3}[ \-.]?)?(?:\(\d{3}\) ?|\d{3}[ \-.])\d{3}[ \-.]\d{4}(?![\p{L}\p{N}]|[.\-]\d)"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
_TITLE = "(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES) + r")\b\.? "
NAME = r"(?<!\p{L})" + _TITLE + r"\p{Lu}\p{Ll}+(?:[ \-]\p{Lu}\p{Ll}+){0,2}"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "card": CARD.replace(r"\1", r"\2"), "ssn": SSN, "phone": PHONE,
         "ip": IP, "name": NAME}
#: One pattern finds all of them, so that entities never overlap; split() and the list of matches then fit together.
PATTERN = "(" + "|".join(KINDS.values()) + ")"
#: What every entity has in it; texts without any are not searched.
HINT = r"[0-9@]|(?<!\p{L})" + _TITLE + r"|(?i:" + "|".join(SECRET_NAMES) + ")"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
GREEK, CYRILLIC = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
#: Letters by script and case, and what replaces them; letters of other scripts stay.
SCRIPTS = {r"[\p{IsGreek}&&\p{Lu}]": GREEK.upper(), r"\p{IsGreek}": GREEK,
           r"[\p{IsCyrillic}&&\p{Lu}]": CYRILLIC.upper(), r"\p{IsCyrillic}": CYRILLIC,
           r"[\p{IsLatin}&&\p{Lu}]": UPPER, r"\p{IsLatin}": LOWER}


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    return F.pmod(_luhn_sum(number), F.lit(10)) == 0


def _luhn_sum(number: Column) -> Column:
    digits = F.reverse(F.split(number, ""))
    worth = F.transform(digits, lambda d, k: F.when(k % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
                        .otherwise(d.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def kind_of(found: Column) -> Column:
    """The kind of a match, null for a number that is none."""
    out = None
    for kind, pattern in KINDS.items():
        hit = F.regexp_like(found, F.lit("^(?:" + pattern.replace(r"\2", r"\1") + ")$"))
        value = F.lit(kind)
        if kind == "card":
            digits = F.regexp_replace(found, r"\D", "")
            value = F.when(F.regexp_like(digits, F.lit(ISSUED)) & luhn(digits), value)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def normal(kind: Column, found: Column) -> Column:
    """What all spellings of an entity have in common."""
    return (F.when(kind == "email", F.lower(found))
            .when(kind.isin("card", "ssn", "phone"), F.regexp_replace(found, r"\D", ""))
            .when(kind == "iban", F.replace(found, F.lit(" ")))
            .when(kind == "secret", F.regexp_extract(found, r"[=:]\s*[\"']?([A-Za-z0-9+/_\-]+)", 1))
            .when(kind == "name", F.regexp_replace(found, "^" + _TITLE, ""))
            .otherwise(found))


def _draw(k: Column | int) -> Column:
    """The k-th number below 2^28 of the entity's keyed hash ``h``."""
    at = F.lit(1) + F.lit(4) * (k if isinstance(k, Column) else F.lit(k)) % 248
    return F.conv(F.substr(F.col("h"), at.cast("int"), F.lit(7)), 16, 10).cast("long")


def _pick(table: str | list[str], k: Column | int, size: int | Column | None = None) -> Column:
    nth = (_draw(k) % (len(table) if size is None else size)).cast("int") + 1
    return F.substr(F.lit(table), nth, F.lit(1)) if isinstance(table, str) else F.element_at(F.array(*map(F.lit, table)), nth)


def _like(text: Column, shift: int = 0) -> Column:
    """Each letter and digit replaced by one of its script, case and class; all else stays."""
    hexadecimal = F.regexp_like(text, F.lit("^[0-9a-f]{16,}$"))

    def other(c: Column, k: Column) -> Column:
        out = F.when(F.regexp_like(c, F.lit("[0-9]")), _pick(DIGITS, k + shift))
        for pattern, table in SCRIPTS.items():
            size = F.when(hexadecimal, 6).otherwise(26) if table == LOWER else None
            out = out.when(F.regexp_like(c, F.lit(pattern)), _pick(table, k + shift, size))
        return out.otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), other), "")


def surrogate(kind: Column, entity: Column) -> Column:
    """The surrogate in normal form, from the hash in column ``h``; the number of the attempt is in ``attempt``."""
    like = _like(entity)
    extra = F.greatest(F.col("attempt") - GROWS, F.lit(0))
    more = lambda table, at: F.array_join(F.transform(F.array_repeat(F.lit(""), extra), lambda _, k: _pick(table, k + at)), "")
    longer = more(LOWER, 20)
    local, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    email = F.concat(_like(local), longer, F.lit("@"), _like(F.regexp_replace(host, r"\.[^.]*$", ""), 31), F.lit("."),
                     F.substring_index(host, ".", -1))
    body = F.concat(F.substr(entity, F.lit(1), F.lit(4)), F.substr(like, F.lit(5), F.lit(11)))     # the issuer stays
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    country = F.length(entity) - 10
    phone = F.concat(F.substr(entity, F.lit(1), country), F.substr(like, country + 1, F.lit(10)))
    octet = lambda k: (_draw(k) % 254 + 1).cast("string")
    given = (F.when(F.startswith(entity, F.lit("f:")), _pick(FEMALE_NAMES, 0)).when(
        F.startswith(entity, F.lit("m:")), _pick(MALE_NAMES, 0)).otherwise(_pick(MALE_NAMES + FEMALE_NAMES, 0)))
    family = F.initcap(F.concat(*(_pick(SYLLABLES, k) for k in range(1, 5)), more(SYLLABLES, 5)))
    # a Latin name keeps having a given name or none; other scripts are replaced letter by letter
    real = F.substr(entity, F.lit(3))
    name = (F.when(~F.regexp_like(real, F.lit(r"^[\p{IsLatin} \-]*$")), F.concat(_like(real), _like(F.expr("repeat(right(entity, 1), cast(greatest(attempt - %d, 0) as int))" % GROWS), 20)))
            .when(F.regexp_like(real, F.lit("[ \\-]")), F.concat_ws(" ", given, family)).otherwise(family))
    return (F.when(kind == "email", email).when(kind == "card", F.concat(body, check)).when(kind == "phone", phone)
            .when(kind == "iban", F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.substr(like, F.lit(3))))
            .when(kind == "ip", F.concat_ws(".", *map(octet, range(4)))).when(kind == "name", name)
            .when(kind == "secret", F.concat(like, longer)).otherwise(like))


def dressed(kind: Column, found: Column, fake: Column) -> Column:
    """A surrogate in the spelling of the match: its separators, quotes and form of address."""
    chars = F.split(found, "")
    # the k-th letter or digit of the match takes the k-th of the surrogate
    kept = F.when(kind == "iban", F.lit("[A-Za-z0-9]")).otherwise(F.lit("[0-9]"))
    spelled = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda a, c: F.when(
        F.regexp_like(c, kept), F.struct(F.concat(a["out"], F.substr(fake, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))))["out"]
    return (F.when(kind.isin("card", "ssn", "phone", "iban"), spelled)
            .when(kind == "secret", F.replace(found, normal(kind, found), fake))
            .when(kind == "name", F.concat(F.regexp_extract(found, "^" + _TITLE, 0), fake))
            .otherwise(fake))


def gender(found: Column) -> Column:
    title = lambda them: F.regexp_like(found, F.lit("^(?:" + "|".join(them) + r")\b"))
    return F.when(title(MALE_TITLES), F.lit("m:")).when(title(FEMALE_TITLES), F.lit("f:")).otherwise(F.lit("x:"))


def found_in(text: Column) -> Column:
    """Kind, match and entity of each match in order, of kind null where it is none; null if nothing hints at any."""
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    found = F.transform(matches, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("match")))
    found = F.transform(found, lambda m: m.withField("entity", F.concat(
        F.when(m["kind"] == "name", gender(m["match"])).otherwise(F.lit("")), normal(m["kind"], m["match"]))))
    return F.when(F.regexp_like(text, F.lit(HINT)), found)


def _named(them: DataFrame, attempt: Column, key: str) -> DataFrame:
    """``them`` with column ``fake`` anew."""
    hashed = F.concat(*(F.sha2(F.concat(F.lit(f"{key}/{half}/"), attempt.cast("string"), F.lit("/"), "kind", F.lit("/"), "entity"), 512)
                        for half in (0, 1)))
    return them.withColumn("h", hashed).withColumn("fake", surrogate(F.col("kind"), F.col("entity"))).drop("h")


def mapping(them: DataFrame, key: str = KEY, attempts: int = ATTEMPTS) -> DataFrame:
    """``kind, entity, fake``: no two entities of a kind share a surrogate, and none is an entity of its kind."""
    real = F.when(F.col("kind") == "name", F.regexp_replace("entity", "^.:", "")).otherwise(F.col("entity"))
    them = stored(them.filter("kind is not null").select("kind", "entity", real.alias("real"), F.lit(0).alias("attempt")), "entities")
    named = stored(_named(them, F.col("attempt"), key), "named")
    known = them.select("kind", F.col("real").alias("fake")).distinct()
    for attempt in range(1, attempts + 1):
        owners = named.groupBy("kind", "fake").agg(F.count("*").alias("m"), F.min_by("entity", F.struct("attempt", "entity")).alias("stays"))
        real_ones = owners.join(known, ["kind", "fake"], "left_semi").select("kind", "fake", F.lit(None).cast("string").alias("stays"))
        taken = stored(owners.filter("m > 1").select("kind", "fake", "stays").join(known, ["kind", "fake"], "left_anti")
                       .unionByName(real_ones), "taken")
        if taken.isEmpty():
            return named.select("kind", "entity", "fake")
        redo = named.join(taken.withColumn("hit", F.lit(True)), ["kind", "fake"], "left")
        stay = F.col("hit").isNull() | F.equal_null("stays", "entity")
        again = redo.filter(~stay).select("kind", "entity", "real", F.lit(attempt).alias("attempt"))
        named = stored(redo.filter(stay).select(*named.columns).unionByName(_named(again, F.col("attempt"), key).select(*named.columns)),
                       "named")
    raise ValueError("a format has too few surrogates for the entities that have it")


def replaced(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """All rows and columns, entities in ``text`` replaced; their number in a column ``count`` if it is named.

    Only rows with entities are stored, numbered and joined with the surrogates.
    """
    # the rows travel in a struct, so that no column of theirs can clash
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), found_in(F.col("text")).alias("found"))
    some = F.coalesce(F.exists("found", lambda m: m["kind"].isNotNull()), F.lit(False))
    counted = lambda n: [n.cast("int").alias(count)] if count else []
    clean = every.filter(~some).select("row.*", *counted(F.lit(0)))
    rows = stored(every.filter(some).withColumn("nth_row", F.monotonically_increasing_id()), "with-entities")
    found = rows.select("nth_row", F.posexplode("found").alias("nth", "m")).select("nth_row", "nth", "m.*")
    fakes = (found.join(mapping(found.select("kind", "entity").distinct(), key), ["kind", "entity"], "left")
             .withColumn("new", F.coalesce(dressed(F.col("kind"), F.col("match"), F.col("fake")), "match"))
             .groupBy("nth_row").agg(F.sort_array(F.collect_list(F.struct("nth", "new"))).alias("new"), F.count("kind").alias("n")))
    gaps = F.split(F.col("row.text"), PATTERN, -1)
    text = F.array_join(F.zip_with(gaps, "new", lambda g, m: F.concat(g, F.coalesce(m["new"], F.lit("")))), "")
    new = rows.join(fakes, "nth_row").select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns),
                                             *counted(F.col("n")))
    return clean.unionByName(new)


def without_private_data(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with surrogates, their number of characters being what it is now."""
    out = replaced(docs, key)
    if "n_chars" not in docs.columns:
        return out
    now = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("n_chars", F.coalesce(now, "n_chars"))
