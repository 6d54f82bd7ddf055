"""Personal data replaced by surrogates of the same kind, in DataFrame operations only.

Found are e-mail addresses; phones behind +, 00 or a trunk 0, in the North American plan, as ddd-dddd, or behind a
word like tel; IPv4 and IPv6 addresses; payment cards (16 digits in fours; 13 to 19 digits with a right check digit);
secrets (long hexadecimal, behind keys like password=, issuers' prefixes, runs of high entropy); names behind a title.
An entity is its kind and normal form: lower case without the title's spelling, or the
digits alone, so that differently written mentions are one entity. Its surrogate comes from a keyed hash: digits
stay digits, letters stay letters of their script and case, octets keep their number of digits, hexadecimal stays
hexadecimal, names keep the title and get a name of its gender and script; separators, the top-level domain and
the first digit of phones and cards are kept, and a right check digit of a card is followed by a right one. Titles
may follow titles (``Frau Dr.``); hyphenated names and names with particles are taken whole.

The same entity gets the same surrogate in all texts, different entities get different ones, and no surrogate is an
entity of the texts: candidates are checked against all entities and against each other in a table of different
entities, and those that collide try again with the next hash, in rounds that are stored. An entity that finds no
free surrogate in ``ATTEMPTS`` rounds (tiny formats can be used up) becomes a unique tag in angle brackets.

Texts without entities pass through unshuffled. Others are joined with their surrogates by a hash of the text, so
copies are looked up once. Null and empty texts stay as they are; repeated rows are rewritten alike; all columns are
kept; a column named like the counter is replaced; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoloom.llm.tables import own_names, stored

ATTEMPTS = 24

# Titles by the gender they tell.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа")
GIVEN_NAMES = {
    ("m", "latin"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jakob Kurt Leon Martin Noah Oscar Paul".split(),
    ("f", "latin"): "Anna Berta Clara Dora Emma Flora Gerda Helen Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Юрий".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса София Юлия".split(),
}
SYLLABLES = {
    "latin": "bal cor den fal gor han kel lan mer nor pel ran sel tor vel win".split(),
    "cyrillic": "бал вар гор дол жар зен кал лес мар нов пол рад сел тор фед шан".split(),
}
# Titles that may follow a title, and particles that belong to a name.
FOLLOWING_TITLES = ("Dr", "Prof", "Dipl", "Ing")
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu")
_ACCENTED = "àáâäçèéêëìíîïñòóôöùúûüß"

_WORDY = r"\p{L}\p{N}"
_GAP = r"[^\p{L}\p{N}\n]"
EMAIL = rf"(?<![{_WORDY}._%+-])[{_WORDY}._%+-]++@(?:[{_WORDY}-]++\.)+\p{{L}}{{2,}}"
_ALONE, _SEP = rf"(?<![{_WORDY}]|\d[.-])", r"[  .\-‐-–/()]{0,3}"
_DATE = r"\d{1,2}([./-])\d{1,2}[./-](?:\d{4}|\d{2})(?!\d|[ ./-]\d)".replace("(", "(?:", 1)
PHONE = "|".join(
    [
        rf"\+\d{{1,3}}{_GAP}{{0,6}}\(\d{{2,4}}\){_GAP}{{1,6}}\d{{3}}-\d{{4}}(?!\d)",
        # +1 and the North American plan, with or without its prefix.
        rf"(?<![{_WORDY}+])\+1{_SEP}\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}(?!\d)",
        rf"{_ALONE}(?:1[ .-])?(?:\(\d{{3}}\)[ .-]?|\d{{3}}[ ./-])\d{{3}}[ .-]\d{{4}}(?!\d|[.-]\d)",
        # International, behind + or 00.
        rf"(?<![{_WORDY}+])\+[1-9](?:{_SEP}\d){{6,14}}(?!\d)",
        rf"{_ALONE}00[1-9]\d{{0,2}}[ ./()-](?:{_SEP}\d){{6,12}}(?!\d)",
        # National, behind a 0: area code and number, or pairs of digits.
        rf"{_ALONE}(?!{_DATE})0\d(?:[ .-]\d\d){{4}}(?!\d|[.-]\d)",
        rf"{_ALONE}(?!{_DATE})(?=\(?\d(?:[ ()/-]{{0,3}}\d){{6}})\(?0\d{{1,4}}\)?(?: ?[/-] ?| )\d{{3,8}}(?:[ -]\d{{2,5}}){{0,2}}(?!\d|[.-]\d)",
        # Any grouping behind a word that announces a phone.
        rf"(?<=(?i:tel|phone|fon|mobile|mobil|cell|call|fax)[.:]{{0,2}} {{0,2}})\(?\d(?:{_SEP}\d){{6,14}}(?!\d)",
        r"(?<![\d-])\d{3}-\d{4}(?![\d-])",
    ]
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ADDRESS = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_SHORTENED = "|".join(rf"(?:{_HEX}:){{1,{n}}}(?::{_HEX}){{1,{7 - n}}}" for n in range(1, 7))
ADDRESS6 = (
    rf"(?<![{_WORDY}:.])(?=[A-Fa-f:]{{0,38}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|{_SHORTENED}|:(?::{_HEX}){{1,7}}|(?:{_HEX}:){{1,7}}:)"
    rf"(?![{_WORDY}:]|\.\d)"
)
# Sixteen digits in fours count as they are; other lengths and groupings with a right check digit only.
_CARD_FOURS = r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}"
_CARD_OTHER = r"[1-9]\d{12,18}|[1-9]\d{3}[ .-]\d{6}[ .-]\d{4,5}|[1-9]\d{5}[ .-]\d{13}|[1-9]\d{3}(?:[ .-]\d{4}){2}(?:[ .-]\d{4}){0,1}[ .-]\d{1,4}"
CARD = rf"(?<!\d)(?:{_CARD_FOURS}(?![ -]?\d)|{_CARD_OTHER}|{_CARD_FOURS})(?!\d)"
SECRET = rf"(?<![{_WORDY}])(?:0[xX])?[0-9A-Fa-f]{{24,}}(?![{_WORDY}])"
# Values behind a telling key: anything behind =, and what isn't a plain word behind a colon.
_KEYWORD = (
    rf"(?i:passwords?|passwd|passphrase|pwd|secret|tokens?|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?key|bearer)"
)
_VALUE = r"[^\s\"'`,;<>(){}\[\]]"
_ASSIGN = rf"{_KEYWORD}(?:[_-][\w-]{{0,30}})?[\"']?(?: {{0,3}}=>? {{0,3}}[\"']?| {{0,3}}: {{0,3}}[\"']?(?=\p{{L}}*[^\s\p{{L}}\"'`,;.<>(){{}}\[\]!?]))"
ASSIGNED = rf"(?<![{_WORDY}]){_ASSIGN}{_VALUE}{{6,}}"
# Keys of known issuers, and long runs of mixed characters that are judged by their entropy.
_ISSUED = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?"
)
_MIXED = r"(?=[A-Za-z+/_-]{0,80}\d)(?=[0-9A-Z+/_-]{0,80}[a-z])(?=[0-9a-z+/_-]{0,80}[A-Z])[A-Za-z0-9+/_-]{24,}+={0,2}"
KEY = rf"(?<![\w+/=.:@-])(?:{_ISSUED}|{_MIXED})(?![{_WORDY}@])"
_TITLE = rf"(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)})\.? "
_ANY_TITLE = f"(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + FOLLOWING_TITLES)})"
_TITLES = rf"{_TITLE}(?:{_ANY_TITLE}\.? ){{0,3}}"
# A part of a name is no title, so that titles without a name behind them are none.
_PART = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}\p{{Lu}}\p{{L}}+(?:-\p{{Lu}}\p{{L}}+){{0,2}}"
NAME = rf"(?<![{_WORDY}]){_TITLES}(?!{_ANY_TITLE}(?![{_WORDY}])){_PART}(?: {_PART})?"
ENTITY = "|".join([ASSIGNED, EMAIL, ADDRESS6, SECRET, KEY, CARD, PHONE, ADDRESS, NAME])
# What every entity holds, to turn most texts away quickly.
_HINT = rf"[0-9@]|{_KEYWORD}|(?<![{_WORDY}]){_TITLE}(?:\p{{Lu}}|(?:{'|'.join(PARTICLES)}) )"
# Bits a character from which a run of mixed characters counts as a secret.
LEAST_ENTROPY = 3.9

_DIGITS = ("phone", "card")


def _check_sum(value: Column) -> Column:
    """The sum that the check digit of a card makes a multiple of ten."""
    digits = F.transform(
        F.split(F.reverse(F.regexp_replace(value, r"\D", "")), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10


def _luhn(value: Column) -> Column:
    return _check_sum(value) == 0


def _entropy(value: Column) -> Column:
    characters = F.split(value, "")

    def share(c: Column) -> Column:
        return F.size(F.filter(characters, lambda x: x == c)) / F.size(characters)

    return F.aggregate(F.array_distinct(characters), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def kind_of(value: Column) -> Column:
    """The kind of what ``ENTITY`` found; null for digits that fail the check digit and runs of low entropy."""
    bare = F.regexp_replace(value, f"^{_ASSIGN}(?={_VALUE}{{6}})", "")
    hexadecimal = bare.rlike(r"^(?:0[xX])?[0-9A-Fa-f]{24,}$")
    return (
        F.when(value.rlike(f"^{ASSIGNED}$"), F.when(hexadecimal, "secret").otherwise("key"))
        .when(F.contains(value, F.lit("@")), "email")
        .when(value.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "address")
        .when(value.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f]*:[0-9A-Fa-f:]*$"), "address6")
        .when(value.rlike(f"^{_CARD_FOURS}$"), "card")
        .when(hexadecimal, "secret")
        .when(value.rlike(f"^(?:{_CARD_OTHER})$"), F.when(_luhn(value), "card"))
        .when(value.rlike(f"^(?:{_ISSUED})$"), "key")
        .when(value.rlike(f"^{_MIXED}$"), F.when(_entropy(value) >= LEAST_ENTROPY, "key"))
        .when(value.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def _title(value: Column) -> Column:
    """What stays in front of an entity: the title of a name, or the key that announces a secret."""
    return F.regexp_extract(value, rf"^(?:{_TITLES}|{_ASSIGN}(?={_VALUE}{{6}}))", 0)


def normal_form(kind: Column, value: Column) -> Column:
    male = _title(value).rlike(rf"^(?:{'|'.join(MALE_TITLES)})\.? ")
    bare = F.expr("substring(value, length(title) + 1)")
    name = F.concat(F.when(male, "m").otherwise("f"), F.lit(":"), F.lower(bare))
    return (
        F.when(kind.isin(*_DIGITS), F.regexp_replace(value, r"\D", ""))
        .when(kind == "name", name)
        .when(kind == "secret", F.lower(bare))
        .when(kind == "key", bare)
        .otherwise(F.lower(value))
    )


def _pick(words: list[str], byte: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (byte % len(words) + 1).cast("int"))


def _byte(place: Column) -> Column:
    """Byte number ``place`` (modulo 64) of the hash column ``h``."""
    return F.conv(F.substring(F.col("h"), (place % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(first: str, count: int, byte: Column) -> Column:
    return F.substring(F.lit("".join(chr(ord(first) + i) for i in range(count))), byte % count + 1, F.lit(1))


def _by_character(keep: Column | None = None, hexadecimal: bool = False) -> Column:
    """``norm`` with each character replaced by one of its class; ``keep``: condition on (character, place)."""

    def one(c: Column, i: Column) -> Column:
        byte = _byte(i)
        letter = _letters("a", 6 if hexadecimal else 26, byte)
        new = (
            F.when(c.rlike("[0-9]"), _letters("0", 10, byte))
            .when(c.rlike("[a-z]"), letter)
            .when(c.rlike("[A-Z]"), F.upper(letter))
            .when(c.rlike(f"[{_ACCENTED}]"), F.substring(F.lit(_ACCENTED), byte % len(_ACCENTED) + 1, F.lit(1)))
            .when(c.rlike(r"\p{IsCyrillic}"), _letters("а", 32, byte))
            .when(c.rlike(r"\p{IsGreek}"), _letters("α", 17, byte))
            .when(c.rlike(r"\p{L}"), letter)
            .otherwise(c)
        )
        return new if keep is None else F.when(i < keep, new).otherwise(c)

    return F.array_join(F.transform(F.split("norm", ""), one), "")


def surrogate_code(secret: str, attempt: int) -> Column:
    """The surrogate's normal form for (kind, norm), by the keyed hash number ``attempt`` in column ``h``."""
    top_level = F.length("norm") - F.length(F.substring_index("norm", ".", -1))
    octets = F.transform(
        F.split("norm", r"\."),
        lambda o, i: F.when(F.length(o) == 3, F.lit(100) + _byte(i) % 156)
        .when(F.length(o) == 2, F.lit(10) + _byte(i) % 90)
        .otherwise(F.lit(1) + _byte(i) % 9)
        .cast("string"),
    )
    digits = F.concat(F.substring("norm", 1, 1), F.expr("substring(mapped, 2)"))

    def full_name(gender: str, script: str) -> Column:
        surname = F.initcap(F.concat(*[_pick(SYLLABLES[script], _byte(F.lit(1 + i))) for i in range(4)]))
        given = _pick(GIVEN_NAMES[gender, script], _byte(F.lit(0)))
        return F.when(F.contains("norm", F.lit(" ")), F.concat(given, F.lit(" "), surname)).otherwise(surname)

    cyrillic, male = F.col("norm").rlike(r"\p{IsCyrillic}"), F.col("norm").startswith("m:")
    name = (
        F.when(cyrillic & male, full_name("m", "cyrillic"))
        .when(cyrillic, full_name("f", "cyrillic"))
        .when(male, full_name("m", "latin"))
        .otherwise(full_name("f", "latin"))
    )
    return (
        F.when(F.col("kind") == "email", _by_character(keep=top_level))
        .when(F.col("kind") == "address", F.array_join(octets, "."))
        .when(F.col("kind").isin(*_DIGITS), digits)
        .when(F.col("kind") == "address6", _by_character(hexadecimal=True))
        .when((F.col("kind") == "secret") & F.col("norm").startswith("0x"), F.concat(F.lit("0x"), F.expr("substring(hexed, 3)")))
        .when(F.col("kind") == "secret", F.col("hexed"))
        .when(F.col("kind") == "key", F.col("mapped"))
        .otherwise(F.concat(F.substring("norm", 1, 2), F.lower(name)))
    )


def _candidates(entities: DataFrame, secret: str, attempt: int) -> DataFrame:
    hashed = F.sha2(F.concat_ws("|", F.lit(secret), "kind", "norm", F.lit(str(attempt))), 512)
    rows = entities.withColumn("h", hashed).withColumn("mapped", _by_character())
    rows = rows.withColumn("hexed", F.when(F.col("kind") == "secret", _by_character(hexadecimal=True)))
    rows = rows.withColumn("code", surrogate_code(secret, attempt))
    # A card whose check digit is right gets a surrogate whose check digit is right.
    body = F.expr("substring(code, 1, length(code) - 1)")
    checked = F.concat(body, ((10 - _check_sum(F.concat(body, F.lit("0")))) % 10).cast("int").cast("string"))
    code = F.when((F.col("kind") == "card") & _luhn(F.col("norm")), checked).otherwise(F.col("code"))
    return rows.select("kind", "norm", code.alias("code"))


def surrogate_table(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, code): distinct surrogates, none of them an entity, for all different entities."""
    pending, decided = entities, None
    for attempt in range(ATTEMPTS):
        taken = entities.select("kind", F.col("norm").alias("code"))
        if decided is not None:
            taken = taken.unionAll(decided.select("kind", "code"))
        free = _candidates(pending, secret, attempt).join(taken, ["kind", "code"], "left_anti")
        won = free.groupBy("kind", "code").agg(F.min("norm").alias("norm")).select("kind", "norm", "code")
        decided = stored(won if decided is None else decided.unionAll(won), "surrogates")
        pending = stored(pending.join(decided, ["kind", "norm"], "left_anti"), "pending-entities")
        if pending.isEmpty():
            return decided
    tag = F.concat(F.lit("<"), "kind", F.lit("-"), F.sha2(F.concat_ws("|", F.lit(secret), "kind", "norm"), 256), F.lit(">"))
    return decided.unionAll(pending.select("kind", "norm", tag.alias("code")))


def render(kind: Column, value: Column, code: Column) -> Column:
    """The surrogate in the spelling of this mention."""
    digit_at = F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(
                c.rlike("[0-9]"),
                F.substring(code, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"\D", "")), F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )
    bare = F.expr("substring(value, length(title) + 1)")
    same_case = F.array_join(
        F.transform(
            F.split(F.when(kind == "secret", bare).otherwise(value), ""),
            lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(code, i + 1, F.lit(1)))).otherwise(
                F.substring(code, i + 1, F.lit(1))
            ),
        ),
        "",
    )
    name = F.initcap(F.expr("substring(code, 3)"))
    loud = (F.upper(value) == value) & (F.lower(value) != value)
    return (
        F.when(code.startswith("<") & kind.isin("secret", "key"), F.concat(F.col("title"), code))
        .when(code.startswith("<"), code)
        .when(kind == "secret", F.concat(F.col("title"), same_case))
        .when(kind == "key", F.concat(F.col("title"), code))
        .when(kind.isin(*_DIGITS), digit_at)
        .when(kind == "name", F.concat(F.col("title"), F.when(loud, F.upper(name)).otherwise(name)))
        .otherwise(same_case)
    )


def replace_entities(
    docs: DataFrame, secret: str, text: str = "text", counter: str = "n_entities"
) -> DataFrame:
    """The documents with every entity replaced, and the number of replacements in ``counter``."""
    docs = docs.drop(counter)
    found_name, key, new_name, here = own_names(docs, "found", "key", "new", "entities_here")
    hinted = F.coalesce(F.col(text).rlike(_HINT), F.lit(False))
    found = F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0))
    # The full pattern is only tried on hinted texts, once to sort them out and once more where it is found.
    has_entity = F.coalesce(F.when(hinted, F.exists(found, lambda x: kind_of(x).isNotNull())), F.lit(False))
    clean = docs.where(~has_entity).withColumn(counter, F.lit(0))
    dirty = docs.where(has_entity).withColumn(found_name, found).withColumn(key, F.sha2(F.col(text), 256))

    texts = dirty.groupBy(key).agg(F.first(found_name).alias("found"))
    mentions = texts.select(key, F.posexplode("found").alias("place", "value"))
    mentions = mentions.withColumn("title", _title(F.col("value"))).withColumn("kind", kind_of(F.col("value")))
    mentions = stored(mentions.withColumn("norm", normal_form(F.col("kind"), F.col("value"))), "mentions")
    real = mentions.where(F.col("kind").isNotNull())
    codes = surrogate_table(stored(real.select("kind", "norm").distinct(), "entities"), secret)
    new = real.join(codes, ["kind", "norm"]).select(
        key, "place", render(F.col("kind"), F.col("value"), F.col("code")).alias("new"), F.lit(1).alias("is_entity")
    )
    # What turned out to be no entity stays as it is.
    same = mentions.where(F.col("kind").isNull()).select(key, "place", F.col("value").alias("new"), F.lit(0).alias("is_entity"))
    by_text = new.unionAll(same).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]).alias(new_name),
        F.sum("is_entity").cast("int").alias(here),
    )
    # Between and around n mentions there are n + 1 pieces of text.
    pieces = F.zip_with(F.split(F.col(text), ENTITY, -1), F.col(new_name), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    rewritten = (
        dirty.join(by_text, key)
        .withColumn(text, F.array_join(pieces, ""))
        .withColumn(counter, F.col(here))
        .select(*docs.columns, counter)
    )
    return clean.unionByName(rewritten)
