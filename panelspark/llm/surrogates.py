"""Surrogates for personal data, in Spark expressions only.

Detected entities (addresses of mail and network, telephone, card and social numbers, bank accounts,
access keys, passwords, tokens, titled names) are replaced by keyed values of the same type and shape:
letters stay letters of their script and case, digits digits, card numbers keep a valid check digit,
given names stay in their gender. One entity has one surrogate wherever and however it is written: the
surrogate belongs to its canonical form (digits of a number, lower-cased mail address, each part of a
name), so "Mrs Ana Lopez" and "Mrs Lopez" still share a surname.

Collision check: over the whole corpus no two entities may get one surrogate, nor may a surrogate be an
entity that occurs. The distinct entities that would are given the next attempt of the keyed hash until
none is left; only these few travel back to the documents, and Spark's size check decides how. Where
``LIMIT`` attempts of the same shape find nothing free, because few values have that shape, each further
attempt is one character longer than the last, so every entity ends with a surrogate of its own.

Null texts stay null, empty ones empty; texts without entities are unchanged to the byte. Repeated rows
are replaced alike. All columns are kept; ``n_chars``, where present, follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import stage_table

# Given names by gender, titles by gender, vowels and consonants by script.
FEMALE = "Anna Maria Julia Sofia Laura Elena Clara Emma Alice Marie Lucia Carla Nora Paula Irene Sara Helena Marta Olivia Eva".split()
MALE = "Peter Paul Martin Thomas David Daniel Marco Pablo Lukas Felix Jonas Simon Victor Adrian Oscar Hugo Julian Robert Walter Bruno".split()
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
TITLES_M = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин"]
TITLES_ANY = ["Dr", "Prof"]
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwz"
VOWELS_C, CONSONANTS_C = "аеиоу", "бвгдзклмнпрст"
VOWELS_G, CONSONANTS_G = "αειου", "βγδζκλμνπρστ"
# Letters of scripts without that distinction here; a letter of any other script becomes a Latin one.
SCRIPTS = {
    "Armenian": "աբգդզէլմնոպստ", "Georgian": "აბგდევზილმნოპრსტ", "Hebrew": "אבגדהוזחטילמנסעפצקרשת", "Arabic": "ابتثجحدرزسشعفقكلمنهوي",
    "Devanagari": "अकगचजटडतदनपबमयरलवस", "Thai": "กขคงจชดตนบปมยรลวสห", "Hangul": "가나다라마바사아자차카타파하",
    "Hiragana": "あいうえおかきくけこさしすせそ", "Katakana": "アイウエオカキクケコサシスセソ", "Han": "天地山水火木日月人口大小中上下左右",
}
ANY = "abcdefghijkmnpqrstuvwxyz23456789"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NAME_PART = r"\p{Lu}[\p{L}'’-]+"
TITLE = "(?:" + "|".join([*TITLES_F, *TITLES_M, *TITLES_ANY]) + ")"
INITIALS = "".join(sorted({t[0] for t in [*TITLES_F, *TITLES_M, *TITLES_ANY]}))
MAIL_CHAR = "[A-Za-z0-9._%+-]"
MAIL_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# Each alternative begins with what a single character can rule out, so plain words cost little.
NUMBERED = (
    r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?![0-9A-Za-z])",
    r"(?<![\p{L}\d])[a-z]{2}\d{2}(?=[a-z]{0,8}\d{6})[a-z0-9]{11,30}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{0,30}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])",
    rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    r"(?<![\p{L}\d])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)",
    r"(?<![\p{L}\d])\d{13,19}(?![\p{L}\d])",
    r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\p{L}\d])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    r"(?<![\p{L}\d])\+(?=(?:[ .()-]{0,2}\d){8,15}(?!\d))\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\d)",
    r"(?<![\p{L}\d.-])\d{3}([-.])\d{3}\1\d{4}(?![\d-])",
    r"(?<![\p{L}\d])0\d{2,4}[ /-]\d{6,8}(?!\d)",
    r"(?<![\p{L}\d])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
)
PATTERNS = (
    rf"(?:\G|(?<!{MAIL_CHAR})){MAIL_CHAR}++{MAIL_DOMAIN}",
    r"(?=AKIA)(?<![\p{L}\d])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"(?<=[=:\"'])(?<=(?i:password|passwd|passphrase|secret)[=:][\"']?)[^\s\"',;]+",
    r"(?<=[=: \"'])(?=[^\s\"',;]{0,60}[0-9_@#$%^&*+!])(?<=(?i:password|passwd|passphrase|secret) {0,2}[=:] {0,2}[\"']?)[^\s\"',;]+",
    r"(?<=[=: \"'])(?=[0-9A-Za-z_-]{0,60}\d)(?<=(?i:token|api[_-]?key|access[_-]?key|secret[_-]?key) ?[=:] ?[\"']?)[0-9A-Za-z_-]{12,}",
    "(?=[0-9A-Za-z+(])(?:" + "|".join(NUMBERED) + ")",
    rf"(?=[{INITIALS}])(?<!\p{{L}}){TITLE}\.? {NAME_PART}(?: {NAME_PART}){{0,2}}",
)
ENTITY = "|".join(PATTERNS)
#: What every match of ``ENTITY`` contains: texts without it hold no entity. A test draws matches of each pattern.
QUICK = rf"[0-9@=:]|AKIA|(?=[{INITIALS}]){TITLE}\.? \p{{Lu}}"
#: A private-use character that sets entities off; texts that hold it take the plain way.
MARK = "\ue000"
#: Attempts that keep the length; later ones add one character each.
LIMIT = 40


def pieces(text: Column) -> Column:
    """The text cut at its entities: plain pieces at even places, entities at odd ones; null without any.

    One pass of the patterns gives both.
    """
    marked = F.split(F.regexp_replace(text, F.lit(ENTITY), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    plain, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    dealt = F.flatten(F.transform(plain, lambda p, i: F.when(i < F.size(found), F.array(p, F.get(found, i))).otherwise(F.array(p))))
    return F.when(text.rlike(QUICK), F.when(text.contains(MARK), dealt).otherwise(marked))


def entities(cut: Column) -> Column:
    """The entities of a text in order, from its pieces."""
    return F.coalesce(F.filter(cut, lambda p, i: i % 2 == 1), F.array().cast("array<string>"))


def kind(entity: Column) -> Column:
    digits = F.length(F.regexp_replace(entity, r"\D", ""))
    return (
        F.when(entity.contains("@") & entity.rlike(f"^{MAIL_CHAR}+{MAIL_DOMAIN}$"), "mail")
        .when(entity.rlike(rf"^{TITLE}\.? \p{{Lu}}"), "name")
        .when(entity.rlike(r"^AKIA[0-9A-Z]{16}$"), "access_key")
        .when(entity.rlike(r"^(?:[A-Z]{2}\d{2}[ A-Z0-9]+|[a-z]{2}\d{2}(?=.*\d{6})[a-z0-9]{11,30})$"), "account")
        .when(entity.rlike(r"^[0-9A-Fa-f:]+$") & entity.contains(":"), "ip6")
        .when(entity.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "ip")
        .when((entity.rlike(r"^[+(][\d ().-]+$") & (digits >= 7)) | entity.rlike(r"^(?:\d{3}([-.])\d{3}\1\d{4}|0\d{2,4}[ /-]\d{6,8})$"), "phone")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
        .when(entity.rlike(r"^[\d -]+$") & (digits >= 13), "card")
        .otherwise("secret")
    )


def units(entity: Column) -> Column:
    """The parts of an entity that have surrogates of their own: kind and canonical form."""
    k = kind(entity)
    part = lambda name, value: F.struct(name.alias("kind"), value.alias("unit"))
    names = F.slice(F.split(entity, " "), 2, 3)
    woman, man = entity.rlike("^(" + "|".join(TITLES_F) + r")\b"), entity.rlike("^(" + "|".join(TITLES_M) + r")\b")
    given = lambda n, i: F.when((i == F.size(names) - 1), "family").when(n.isin(*FEMALE), "female").when(n.isin(*MALE), "male").when(woman, "female").when(man, "male").otherwise("family")
    canonical = F.when(k == "mail", F.lower(entity)).when(k.isin("phone", "card", "social"), F.regexp_replace(entity, r"\D", "")).when(k == "account", F.upper(F.replace(entity, F.lit(" "), F.lit("")))).when(k == "ip6", F.lower(entity)).otherwise(entity)
    return F.when(k == "name", F.transform(names, lambda n, i: part(given(n, i), F.lower(n)))).otherwise(F.array(part(k, canonical)))


def _hash(key: str, k: Column, unit: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), k, unit, attempt.cast("string")), 512)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value written once: repeated, the expressions below would grow without bound."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, (i * 3) % 121 + 1, F.lit(6)), 16, 10).cast("long")


def _draw(h: Column, i: Column, n: int) -> Column:
    """A keyed number below n for place i."""
    return _number(h, i) % n


def _pick(chars: str, h: Column, i: Column) -> Column:
    return F.substring(F.lit(chars), (_draw(h, i, len(chars)) + 1).cast("int"), F.lit(1))


def _char(c: Column, i: Column, h: Column) -> Column:
    """A character of the same class: digit, vowel or consonant of its script, case kept."""
    low = F.lower(c)
    pool = (
        F.when(low.rlike(r"\P{L}"), None)
        .when(low.rlike("[aeiouyàâäáãéèêëíìîïóòôöõúùûü]"), VOWELS).when(low.rlike(r"\p{IsLatin}"), CONSONANTS)
        .when(low.rlike("[аеёиоуыэюя]"), VOWELS_C).when(low.rlike(r"\p{IsCyrillic}"), CONSONANTS_C)
        .when(low.rlike("[αεηιουω]"), VOWELS_G).when(low.rlike(r"\p{IsGreek}"), CONSONANTS_G)
    )
    for script, chars in SCRIPTS.items():
        pool = pool.when(low.rlike(rf"\p{{Is{script}}}"), chars)
    letter = _let(pool.otherwise(CONSONANTS), lambda p: F.coalesce(F.substring(p, (_number(h, i) % F.length(p) + 1).cast("int"), F.lit(1)), low))
    return F.when(c.rlike(r"\p{Nd}"), _draw(h, i, 10).cast("string")).otherwise(_let(letter, lambda x: F.when(c != low, F.upper(x)).otherwise(x)))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _each(text: Column, h: Column, change) -> Column:
    return F.array_join(F.transform(_chars(text), lambda c, i: change(c, i, h)), "")


def _more(unit: Column, h: Column, attempt: Column, change) -> Column:
    """What an attempt past ``LIMIT`` adds to the shape: a first character, then one more each time."""
    longer = F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(LIMIT)) - (LIMIT - 1)), lambda j: change(unit, j + 60, h))
    return F.when(attempt >= LIMIT, F.array_join(longer, "")).otherwise("")


def _luhn(body: Column) -> Column:
    """The check digit that makes a card number valid."""
    twice = F.transform(F.reverse(_chars(body)), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return ((10 - F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def surrogate(key: str, k: Column, unit: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical unit."""
    return _let(_hash(key, k, unit, attempt), lambda h: _surrogate(key, k, unit, attempt, h))


def _surrogate(key: str, k: Column, unit: Column, attempt: Column, h: Column) -> Column:
    at = lambda n: F.lit(n)
    more = lambda chars: _more(unit, h, attempt, lambda u, j, x: _pick(chars, x, j))
    more_name = _more(unit, h, attempt, lambda u, j, x: _char(F.regexp_extract(u, r"\p{L}", 0), j, x))
    domain = F.substring_index(unit, "@", -1)
    of_domain = _hash(key, F.lit("domain"), domain, F.lit(0))
    top = F.substring_index(domain, ".", -1)
    mail = F.concat(
        _each(F.substring_index(unit, "@", 1), h, _char), more(ANY), F.lit("@"),
        _each(F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1), of_domain, _char), F.lit("."), top,
    )
    lead = (_draw(h, at(0), 8) + 2).cast("string")
    country = F.length(unit) - 10
    phone = F.concat(F.substring(unit, F.lit(1), F.greatest(country, F.lit(0))), lead, _each(F.substring(unit, F.greatest(country, F.lit(0)) + 2, F.lit(99)), h, lambda c, i, x: _char(c, i + 1, x)), more("0123456789"))
    body = F.concat(F.substring(unit, 1, 1), _each(F.substring(unit, F.lit(2), F.length(unit) - 2), h, lambda c, i, x: _char(c, i + 1, x)), more("0123456789"))
    valid = _luhn(F.substring(unit, F.lit(1), F.length(unit) - 1)) == F.substring(unit, -1, 1)
    card = F.concat(body, F.when(valid, _luhn(body)).otherwise(_draw(h, at(39), 10).cast("string")))
    ip = F.array_join(F.transform(F.split(unit, r"\."), lambda o, i: F.when(F.length(o) == 1, _draw(h, i, 9) + 1).when(F.length(o) == 2, _draw(h, i, 90) + 10).otherwise(_draw(h, i, 156) + 100).cast("string")), ".")
    ip = F.concat(ip, F.when(attempt >= LIMIT, F.concat(F.lit("."), more("0123456789"))).otherwise(""))
    ip6 = F.concat(_each(unit, h, lambda c, i, x: F.when(c == ":", c).otherwise(_pick("abcdef0123456789", x, i))), more("abcdef"))
    access = F.concat(F.lit("AKIA"), _each(F.substring(unit, 5, 16), h, lambda c, i, x: _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", x, i)), more("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
    hexed = F.concat(_each(unit, h, lambda c, i, x: F.when(c.rlike("[A-F]"), F.upper(_pick("abcdef0123456789", x, i))).otherwise(_pick("abcdef0123456789", x, i))), more("abcdef0123456789"))
    # A secret without letters and digits has no class to keep.
    other = F.concat(_each(unit, h, lambda c, i, x: F.when(unit.rlike(r"[\p{L}\p{Nd}]"), _char(c, i, x)).otherwise(_pick(ANY, x, i))), more(ANY))
    account = F.concat(F.substring(unit, 1, 2), _each(F.substring(unit, F.lit(3), F.lit(99)), h, lambda c, i, x: F.when(c.rlike(r"\d"), _char(c, i, x)).otherwise(_pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", x, i))), more("0123456789"))

    def given(pool: list[str]) -> Column:
        names = F.array(*[F.lit(n.lower()) for n in pool])
        one = lambda i: F.element_at(names, (_draw(h, at(i), len(pool)) + 1).cast("int"))
        latin = F.when(attempt < 2, one(0)).otherwise(F.concat(one(0), F.lit("-"), one(5)))
        ending = F.concat(_each(F.substring(unit, F.lit(1), F.length(unit) - 1), h, _char), more_name, F.substring(unit, -1, 1))
        return F.when(unit.rlike(r"^\p{IsLatin}"), F.when(attempt < 6, latin).otherwise(F.concat(latin, F.lit("-"), ending))).otherwise(ending)

    return (
        F.when(k == "mail", mail).when(k == "phone", phone).when(k == "social", F.concat(_each(unit, h, _char), more("0123456789"))).when(k == "card", card).when(k == "ip", ip).when(k == "ip6", ip6)
        .when(k == "access_key", access).when(k == "account", account).when(k == "female", given(FEMALE)).when(k == "male", given(MALE))
        .when(k == "family", F.concat(_each(unit, h, _char), more_name)).when(unit.rlike("^[0-9A-Fa-f]+$"), hexed).otherwise(other)
    )


def _like(old: Column, new: Column) -> Column:
    """A character in lower case where the old one is."""
    return F.when(old != F.upper(old), F.lower(new)).otherwise(new)


def shaped(entity: Column, new: Column) -> Column:
    """Canonical surrogates written in the shape of the entity; what is longer than that follows it."""
    k = kind(entity)
    one = F.element_at(new, 1)
    numbered = F.array_join(
        F.transform(_chars(entity), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), _like(c, F.substring(one, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1)))).otherwise(c)), ""
    )
    numbered = F.concat(numbered, F.substring(one, F.length(F.regexp_replace(entity, "[^0-9A-Za-z]", "")) + 1, F.length(one)))
    like = lambda old, put: F.array_join(F.transform(_chars(old), lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(put, i + 1, F.lit(1)))).otherwise(F.substring(put, i + 1, F.lit(1)))), "")
    mine, user = F.substring_index(entity, "@", 1), F.substring_index(one, "@", 1)
    cased = F.concat(like(mine, user), F.substring(user, F.length(mine) + 1, F.length(user)), F.lit("@"), like(F.substring_index(entity, "@", -1), F.substring_index(one, "@", -1)))
    words = F.split(entity, " ")
    upper = lambda i: F.element_at(words, i + 2).rlike(r"^\P{Ll}+$")
    name = F.concat_ws(" ", F.element_at(words, 1), F.array_join(F.transform(new, lambda n, i: F.when(upper(i), F.upper(n)).otherwise(F.initcap(n))), " "))
    return F.when(k == "name", name).when(k.isin("phone", "card", "social", "account"), numbered).when(k == "mail", cased).otherwise(one)


def attempts(found: DataFrame, key: str) -> DataFrame:
    """kind, unit, attempt of the units whose first surrogates collide, each with the first free attempt.

    Each round keeps the earliest attempt, then the smallest unit of every surrogate and moves the others on, as well as those
    whose surrogate is a unit of the corpus. The rounds handle ever fewer rows; from ``LIMIT`` on they
    lengthen the surrogates, so that also a full shape leaves none without one.
    """
    with_s = lambda df, a: df.withColumn("attempt", a).withColumn("s", surrogate(key, F.col("kind"), F.col("unit"), F.col("attempt")))
    taken = stage_table(with_s(found, F.lit(0)), "surrogates")
    real = found.select("kind", F.col("unit").alias("s"))
    moved = None
    first = taken.groupBy("kind", "s").agg(F.min("unit").alias("owner"))
    late = taken.join(first, ["kind", "s"]).filter("unit != owner").select("kind", "unit")
    bad = stage_table(late.unionByName(taken.join(real, ["kind", "s"], "left_semi").select("kind", "unit")).distinct(), "collisions")
    used = taken.select("kind", "s")
    a = 1
    while not bad.isEmpty():
        # Ever more attempts at once while the length holds: full shapes cost few rounds.
        tries = range(a, max(a + 1, min(2 * a - 1, LIMIT)))
        tried = with_s(bad.withColumn("_a", F.explode(F.array(*[F.lit(t) for t in tries]))), F.col("_a")).drop("_a")
        open_ = stage_table(tried, "surrogates").join(used.unionByName(real), ["kind", "s"], "left_anti")
        mine = open_.groupBy("kind", "s").agg(F.min(F.struct("attempt", "unit")).alias("o")).select("kind", "s", "o.*")
        free = stage_table(mine.groupBy("kind", "unit").agg(F.min(F.struct("attempt", "s")).alias("m")).select("kind", "unit", "m.*"), "surrogates")
        moved = free if moved is None else moved.unionByName(free)
        used = used.unionByName(free.select("kind", "s"))
        bad = stage_table(bad.join(free, ["kind", "unit"], "left_anti"), "collisions")
        a = tries.stop
    return None if moved is None else moved.select("kind", "unit", "attempt")


def replace(docs: DataFrame, key: str = "panelspark", *, text_col: str = "text", count_col: str = "_n_entities") -> DataFrame:
    """All rows and columns of ``docs`` with surrogates in the text, and ``count_col``, which ``docs`` must not have.

    Columns are told apart by place inside, so no name of the caller's can clash.
    """
    if count_col in docs.columns:
        raise ValueError(f"the documents have a column {count_col}; name another count_col")
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    docs = docs.toDF(*own)
    whole = F.col(own[names.index(text_col)])
    text = whole.cast("string")
    key_of = F.xxhash64(text)
    # Only the entities are staged: they are a small part of the texts.
    held = docs.select(key_of.alias("_key"), pieces(text).alias("_cut")).select("_key", entities(F.col("_cut")).alias("e")).filter(F.size("e") > 0)
    held = stage_table(held.select("_key", F.explode(F.array_distinct(F.flatten(F.transform("e", units)))).alias("u")).select("_key", "u.*"), "entities")
    moved = attempts(stage_table(held.select("kind", "unit").distinct(), "units"), key)
    rows = docs.select(*own, pieces(text).alias("_cut"), key_of.alias("_key"))
    rows = rows.withColumn("_entities", entities(F.col("_cut")))
    tries = F.create_map().cast("map<string,int>")
    if moved is not None:
        mine = held.distinct().join(moved, ["kind", "unit"]).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "unit"), "attempt"))).alias("_tries"))
        rows, tries = rows.join(mine, "_key", "left"), F.coalesce("_tries", tries)

    def one(entity: Column) -> Column:
        new = F.transform(units(entity), lambda u: surrogate(key, u["kind"], u["unit"], F.coalesce(F.element_at(tries, F.concat_ws("|", u["kind"], u["unit"])), F.lit(0))))
        return _let(new, lambda made: shaped(entity, made))

    # The distinct entities of a text are computed once; one hit in a long text costs one surrogate.
    table = F.map_from_entries(F.transform(F.array_distinct("_entities"), lambda e: F.struct(e, one(e))))
    rows = rows.withColumn("_table", F.when(F.size("_entities") > 0, table))
    joined = F.array_join(F.transform("_cut", lambda p, i: F.when(i % 2 == 1, F.element_at(F.col("_table"), p)).otherwise(p)), "")
    rows = rows.withColumn("_new", F.when(F.size("_entities") > 0, joined).otherwise(whole))
    out = {text_col: F.col("_new")}
    if "n_chars" in names and text_col != "n_chars":
        at = own[names.index("n_chars")]
        out["n_chars"] = F.when(F.size("_entities") > 0, F.length("_new").cast(docs.schema[at].dataType)).otherwise(F.col(at))
    return rows.select(*[out.get(n, F.col(c)).alias(n) for n, c in zip(names, own)], F.size("_entities").alias(count_col))
